"""Text rules that depend on the data step by step: plain Python functions, and Arrow-batched UDFs made of them."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SAFE_ENDINGS
from tessera.sources.scratch import small_batches

ELLIPSIS = "…"
_BREAKS = set("\n。！？.!?")
_WORD = re.compile(r"[a-z0-9_-]")
_ASCII_TOKEN = re.compile(r"^[a-z0-9_-]+$")
_WIDE = re.compile("[　-〿぀-ヿ㄀-ㄯ㐀-鿿ꀀ-퟿豈-﫿＀-￯\U00020000-\U0003134f]")


def _whole_texts() -> None:
    """For UDFs of whole texts: batches bounded by bytes, as thousands of long texts would fill a worker."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        small_batches(spark)


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, less half the matches that are out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    mine: list[str] = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), -1)
        if j >= 0:
            free[j] = False
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to four equal first characters, at any similarity above 0."""
    j = jaro(a, b)
    if j <= 0:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def jaro_winkler_to(query: str):
    """A UDF that scores a title against a query, both lower-cased."""
    q = query.lower()

    @F.pandas_udf("double")
    def score(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: jaro_winkler(q, t.lower()) if t is not None else None)

    return score


def split_by_tokens(
    body: str, title: str, count: Callable[[str], int], tokens: int = 512, overlap: int = 50, window: int = 2000, title_chars: int = 64
) -> list[str]:
    """Chunks of at most ``tokens`` tokens with the title before each. A chunk is as long as fits (and no longer than the window), cut after a
    sentence or line end in its last fifth if there is one; the next begins overlap characters earlier, at most half a chunk."""
    text = body.strip()
    flat = re.sub(r"[\r\n]", " ", title)[:title_chars]
    prefix = flat + "\n" if title else ""
    if not text:
        return [prefix.rstrip()]
    if count(prefix + text) <= tokens:
        return [prefix + text]
    fits = lambda at, n: count(prefix + text[at : at + n]) <= tokens
    out, at = [], 0
    while True:
        low, high = 1, min(max(1, window), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(at, middle) else (low, middle - 1)
        n = low
        if at + n < len(text):
            cut = next((k for k in range(n, max(1, math.ceil(n * 0.8)) - 1, -1) if text[at + k - 1] in _BREAKS), n)
            if cut != n and fits(at, cut):
                n = cut
        out.append(prefix + text[at : at + n])
        if at + n >= len(text):
            return out
        at += n - min(overlap, n // 2)


def token_chunks(count: Callable[[str], int], **options):
    """A UDF (body, title) -> array of chunks."""
    _whole_texts()

    @F.pandas_udf("array<string>")
    def split(bodies: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([split_by_tokens(b or "", t or "", count, **options) for b, t in zip(bodies, titles, strict=True)])

    return split


def _fold(text: str, simplify: dict[int, int] | None = None) -> str:
    out = text.translate(simplify) if simplify else text
    return out.replace("画", "划").translate({c: c + 32 for c in range(65, 91)})


def find_hits(text: str, tokens: Iterable[str]) -> list[tuple[int, int]]:
    """Merged ranges of the tokens in a text; ASCII tokens must be whole words."""
    folded, hits = _fold(text), []
    for token in dict.fromkeys(t for t in tokens if t):
        whole = bool(_ASCII_TOKEN.match(token))
        at = folded.find(token)
        while at >= 0:
            end = at + len(token)
            inside = whole and ((at and _WORD.match(folded[at - 1])) or (end < len(folded) and _WORD.match(folded[end])))
            if not inside:
                hits.append((at, end))
            at = folded.find(token, at + 1)
    merged: list[list[int]] = []
    for a, b in sorted(hits):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _fold_blanks(text: str, ranges: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    out, place, pending = [], [], False
    for c in text:
        if c.isspace() or c == "﻿":
            place.append(len(out))
            pending = True
            continue
        if pending and out:
            out.append(" ")
        pending = False
        place.append(len(out))
        out.append(c)
    place.append(len(out))
    return "".join(out), [(place[a], place[b]) for a, b in ranges]


@dataclass(frozen=True)
class Source:
    """A text that a snippet may be cut from: where it came from, and of a chunk its place among the note's chunks."""

    kind: str
    content: str
    index: int | None = None
    count: int | None = None
    centred: bool = True  # on the first hit; else the beginning is shown

    def usable(self) -> bool:
        return bool(self.content and self.content.strip())


@dataclass(frozen=True)
class View:
    """How much is shown: the window, what comes before a hit in it, and the anchor text that finds the place again."""

    window: int = 120
    lead: int = 20
    anchor: int = 40


def _hits_in(content: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Hits of the telling tokens; single characters beyond ASCII count only where nothing else is found."""
    telling = [t for t in tokens if len(t) > 1 or _ASCII_TOKEN.match(t)]
    return find_hits(content, telling) or find_hits(content, tokens)


def cut_snippet(source: Source, tokens: list[str], view: View = View()) -> dict:
    """A window of a text with the ranges of the hits in it."""
    hits, n = _hits_in(source.content, tokens), len(source.content)
    focus = hits[0][0] if source.centred and hits else 0
    left = min(max(focus - view.lead, 0), max(n - view.window, 0)) if focus else 0
    right = min(left + view.window, n)
    inside = [(max(a - left, 0), min(b, right) - left) for a, b in hits if a < right and left < b]
    shown, ranges = _fold_blanks(source.content[left:right], inside)
    place = min(focus, max(n - view.anchor, 0))
    out = {"text": shown, "ranges": [dict(s=a, e=b) for a, b in ranges], "source": source.kind, "chunk_index": source.index, "chunk_count": source.count}
    kept = source.kind != "description"  # a description isn't part of the note's text
    return out | {"anchor": source.content[place : place + view.anchor] if kept else None, "anchor_ratio": place / n if kept else None}


SNIPPET = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))),
    T.StructField("source", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_count", T.IntegerType()), T.StructField("anchor_ratio", T.DoubleType()),
])


def build_snippet(
    tokens: list[str], keyword_rank: int | None, semantic_rank: int | None, keyword: tuple[int, str] | None, description: str | None, semantic: tuple[int, str] | None,
    weights: tuple[float, float] = (1.0, 1.0), k: int = 60, count: int | None = None, verbatim: tuple[int, str, str] | None = None,
):
    """The snippet of a result, or None. Rule: the chunk that has the query word for word comes before all, if it shows it; then the legs by their
    share of the score (the keyword leg on a tie; a note's description stands in for a missing chunk of it); a snippet
    that shows a query word comes before one that shows none. A result that only its title matched has no snippet.
    Hits are (chunk index, content)."""
    if verbatim:
        exact = Source("bm25", verbatim[1], verbatim[0], count)
        if exact.usable() and (found := cut_snippet(exact, [verbatim[2]]))["ranges"]:
            return found
    legs = []  # (share, order, source)
    for order, (rank, weight) in enumerate(((keyword_rank, weights[0]), (semantic_rank, weights[1]))):
        share = weight / (k + rank) if rank else 0.0
        choices = [Source("semantic", semantic[1], semantic[0], count, centred=False)] if order and semantic else []
        if not order:
            choices = [Source("bm25", keyword[1], keyword[0], count)] if keyword else []
            choices += [Source("description", description)] if description else []
        legs.append((share, order, next((x for x in choices if x.usable()), None)))
    if not any(share > 0 for share, _, _ in legs):
        return None
    cut = [cut_snippet(x, tokens) for _, _, x in sorted(legs, key=lambda leg: (-leg[0], leg[1])) if x]
    return min(cut, key=lambda x: not x["ranges"], default=None)  # the first of equals


def _body_start(content: str) -> int:
    end = content.find("---", 3) if content.startswith("---") else -1
    return end + 3 if end >= 0 else 0


def locate_anchor_offset(content: str, anchor: str, index: int | None = None, count: int | None = None, ratio: float | None = 0.0) -> int | None:
    """Where the anchor text stands; of several places the one nearest to where the chunk should be."""
    if not anchor:
        return None
    body = _body_start(content)
    places, at = [], content.find(anchor, body)
    while at >= 0:
        places.append(at)
        at = content.find(anchor, at + 1)
    if len(places) > 1 and index is not None and count:
        guess = body + (index + (ratio or 0.0)) * ((len(content) - body) / count)
        return min(places, key=lambda x: abs(x - guess))
    return places[0] if places else None


def locate_anchor(content: str, anchor: str, index: int | None = None, count: int | None = None, ratio: float | None = 0.0) -> int | None:
    """The line, from 0, of the anchor."""
    at = locate_anchor_offset(content, anchor, index, count, ratio)
    return None if at is None else content.count("\n", 0, at)


def anchor_match(content: str, anchor: str, index: int | None = None, count: int | None = None, ratio: float | None = 0.0) -> tuple[int, int] | None:
    """The range of the anchor's first line with text."""
    at = locate_anchor_offset(content, anchor, index, count, ratio)
    lead = re.search(r"\S", anchor)
    if at is None or lead is None:
        return None
    line = anchor.find("\n", lead.start())
    return at + lead.start(), at + (len(anchor) if line < 0 else line)


def _token_weight(c: str) -> float:
    if c < "\x80":
        return 0.3 if c.isalpha() or c in " \n\t" else 1.0
    return 2.0 if c > "￿" else 1.0


def sample_spread(text: str, budget: float = 3000, parts: int = 6, joint: str = "\n…\n") -> str:
    """The text if it fits the token budget; else it is divided into equal parts, and the beginnings of all, one joint between two, share
    the budget equally."""
    cost = np.fromiter(map(_token_weight, text), dtype=np.float64, count=len(text))
    if cost.sum() <= budget:
        return text
    each = (budget - (parts - 1) * sum(_token_weight(c) for c in joint)) / parts
    bounds = [len(text) * i // parts for i in range(parts + 1)]
    fits = lambda a, b: int(np.searchsorted(np.cumsum(cost[a:b]), each + 1e-9, side="right"))
    return joint.join(text[a : a + fits(a, b)] for a, b in zip(bounds, bounds[1:]))


def sample_spread_col(c):
    """sample_spread of a column."""
    _whole_texts()
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else sample_spread(x)), "string")(c)


def display_width(text: str) -> int:
    return len(text) + len(_WIDE.findall(text))


_SENTENCE = re.compile("[。！？][」』）\"'”’]*|[.!?][)\"'」』）”’]*(?=\\s|$)")


def trim_description(text: str, width: int = 500) -> str:
    """Cut to a display width: at the last sentence end that fits, if that keeps half the width, else with an ellipsis. A result that would
    pass for an old cut gets an ellipsis too."""
    if len(text) > width or display_width(text) > width:
        ends = takewhile(lambda e: e <= width, (m.end() for m in _SENTENCE.finditer(text)))  # no character is narrower than 1
        fitting = [e for e in ends if display_width(text[:e]) <= width]
        if fitting and display_width(text[: fitting[-1]]) * 2 >= width:
            text = text[: fitting[-1]].rstrip()
        else:
            kept, w = [], 0
            for c in text:
                w += display_width(c)
                if w > width - 1:
                    break
                kept.append(c)
            text = "".join(kept).rstrip() + ELLIPSIS
    bare = text.rstrip()
    if len(text) in (499, 500) and bare and bare[-1] not in SAFE_ENDINGS:
        text = bare[:-1] + ELLIPSIS
    return text


def trim_description_col(c):
    """trim_description of a column."""
    _whole_texts()
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else trim_description(x)), "string")(c)


def truncate_label(text: str, width: int = 20) -> str:
    if display_width(text) <= width:
        return text
    kept, w = [], display_width(ELLIPSIS)
    for c in text:
        w += display_width(c)
        if w > width:
            break
        kept.append(c)
    return "".join(kept) + ELLIPSIS


def opener(subjects: Iterable[str], verbs: Iterable[str], article: str = "", gap: str = " ") -> re.Pattern:
    """A matcher of openings such as \"This note describes\": a subject and a verb at the beginning, and what separates them from the rest."""
    one = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    return re.compile(rf"(?:{article})(?:{one(subjects)}){gap}(?:{one(verbs)})(?=\W|$|(?<=[^\x00-\x7F]))[\s:：,，、]*", re.I)


#: The openings that are left out where the caller gives no others.
OPENERS = (opener(("note", "article", "text"), ("describes", "discusses", "explains", "covers", "summarizes"), article="(?:this|the) "),)


def strip_boilerplate(text: str, openers: Iterable[re.Pattern] = OPENERS) -> str:
    """The text with its blanks folded, without one opening."""
    folded = " ".join(text.split())
    starts = (m for m in (o.match(folded) for o in openers) if m)
    return folded[max((m.end() for m in starts), default=0) :].strip()


def pick_group_label(tags: list[str] | None, description: str | None, on_canvas: dict[str, int], in_vault: dict[str, int], width: int = 20) -> str | None:
    """A group's label: its tag that is rarest on the canvas, then in the vault, then first by name, with a second one if both fit; without
    tags the description."""
    named: dict[str, str] = {}
    for tag in tags or []:
        bare = tag.removeprefix("#")
        if bare and bare.rpartition("/")[2]:
            named.setdefault(bare.lower(), bare.rpartition("/")[2])
    if named:
        keys = sorted(named, key=lambda k: (on_canvas.get(k, 0), in_vault.get(k, 0), k))
        first = named[keys[0]]
        second = next((named[k] for k in keys[1:] if named[k].lower() != first.lower()), None)
        if second is not None and display_width(f"{first} · {second}") <= width:
            return f"{first} · {second}"
        return truncate_label(first, width)
    text = strip_boilerplate(description) if isinstance(description, str) else ""
    return truncate_label(text, width) if text else None


_HIDDEN = re.compile("[͏᠋-᠍︀-️\U000e0000-\U000e007f]")


def strip_invisibles(text: str, new: str = "") -> str:
    import unicodedata

    return _HIDDEN.sub("", "".join(new if unicodedata.category(c) in ("Cc", "Cf") else c for c in text))


def _object_in(answer: str) -> dict | None:
    """The JSON object of an answer, without the fence around it; an empty one for a list, None where there is no JSON."""
    for candidate in (answer, re.sub(r"```(?:json)?", "", answer)):
        try:
            value = json.loads(candidate.strip())
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
        if isinstance(value, list):
            return {}
    return None


def _tag_list(value, most: int) -> list[str] | None:
    words = re.split(r"[\s,、，]+", value) if isinstance(value, str) else value if isinstance(value, list) else ()
    clean = (strip_invisibles("_".join(str(w).split()))[:most] for w in words)
    return [w for w in clean if w.strip(".…")] or None


def parse_generated(raw: str, most: int = 1000, most_tag: int = 64) -> dict:
    """Description and tags of a model's answer. Rule: the fields of its JSON object (a description may be called summary); an answer that isn't
    JSON is the description itself, unless it looks like a broken object: that gives nothing."""
    found = _object_in(raw)
    if found is None:
        broken = re.sub(r"```(?:json)?", "", raw).lstrip().startswith("{")
        found = {} if broken else {"description": raw[:most]}
    told = [found[k] for k in ("description", "summary") if isinstance(found.get(k), str)]
    return {"description": strip_invisibles(told[0], " ")[:most] if told else "", "tags": _tag_list(found.get("tags"), most_tag)}


def strip_reasoning(text: str) -> str:
    """A model's final answer, without the reasoning before it; raises ValueError if there is none."""
    head = text.lstrip()
    if not head.startswith(("<think>", "<|")):
        return text
    for mark in ("<|channel|>final<|message|>", "</think>"):
        if mark in text:
            return re.sub(r"<\|(end|return|endoftext)\|>\s*$", "", text.rpartition(mark)[2]).strip()
    raise ValueError("reasoning without a final answer")


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def _line_kinds(lines: list[str]) -> tuple[list[str], str | None]:
    """What each line is (meta, code, head or text), and the mark of a code block left open."""
    kinds, open_ = [], None
    meta = lines[0].strip() == "---"
    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        if meta:
            kinds.append("meta")
            meta = i == 0 or line.strip() != "---"
        elif open_:
            kinds.append("code")
            if mark and mark[1].startswith(open_):
                open_ = None
        elif mark:
            kinds.append("code")
            open_ = mark[1]
        else:
            kinds.append("head" if re.match(r"#{1,6}\s", line) else "text")
    return kinds, open_


def insert_related_link(content: str, heading: str, link: str) -> str | None:
    """The note with a bullet for the link in the section under the heading, after the section's last line with text; null if the section has the
    link. Rule for the rest: front matter and code are neither headings nor sections' ends; a missing section is added at the
    note's end; code left open is closed before that, or gets the bullet in front of it."""
    title, bullet, lines = heading.strip(), f"- {link}", content.split("\n")
    kinds, open_ = _line_kinds(lines)
    free = [i for i, kind in enumerate(kinds) if kind in ("head", "text")]
    start = next((i for i in free if lines[i].strip() == title), None)
    if start is None:
        kept = content.rstrip("\n")
        added = [kept, *([open_] if open_ else []), "", title] if kept else [title]
        return "\n".join([*added, bullet, ""])
    stop = next((i for i in free if i > start and kinds[i] == "head"), len(lines))
    section = range(start + 1, stop)
    if any(link in lines[i] for i in section):
        return None
    if open_ and stop == len(lines):
        tail = next(i for i in range(len(lines), 0, -1) if kinds[i - 1] != "code")  # the open block begins here
        section = range(start + 1, max(tail, start + 1))
    place = max((i for i in section if lines[i].strip()), default=start) + 1
    return "\n".join(lines[:place] + [bullet] + lines[place:])


def insert_related_link_col(content, heading, link):
    """insert_related_link of columns."""
    _whole_texts()

    @F.pandas_udf("string")
    def insert(c: pd.Series, h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else insert_related_link(x, y, z) for x, y, z in zip(c, h, k, strict=True)])

    return insert(content, heading, link)
