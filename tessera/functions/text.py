"""Text functions as column expressions: tokenising, folding, chunk windows, cleaning, predicates and projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks that trimming and folding take in: Unicode white space and the byte order mark.
BLANK = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: One token run: CJK (without the emoji planes), word characters, or one supplementary character (fixed classes).
TOKEN_RUN = r"[\x{3400}-\x{9FFF}\x{A000}-\x{D7FF}\x{E000}-\x{FAFF}]+|[A-Za-z0-9_-]+|[\x{10000}-\x{10FFFF}]"
CJK_RUN = r"^[\x{3400}-\x{9FFF}\x{A000}-\x{D7FF}\x{E000}-\x{FAFF}]"
BEYOND_WORDS = r"[\x{3400}-\x{9FFF}\x{A000}-\x{D7FF}\x{E000}-\x{FAFF}\x{10000}-\x{10FFFF}]"
WORD = "a-z0-9_-"
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, _FROM, _FROM.lower())


def trim_all(c: Column) -> Column:
    """Without Unicode white space at either end. Only the ends are looked at."""
    return F.btrim(c, F.lit(_BLANKS))


def normalize_for_search(c: Column, simplify: tuple[str, str] | None = None) -> Column:
    """Variant folding before tokenising: simplify is a pair of strings that map characters one to one (traditional to
    simplified); one more variant follows in any case."""
    if simplify:
        c = F.translate(c, *simplify)
    return F.replace(c, F.lit("画"), F.lit("划"))


def tokenize(c: Column, bigrams: bool = False) -> Column:
    """Tokens in order: CJK runs as trigrams (runs of up to three characters whole), with all bigrams after a run's trigrams if
    asked for; word runs lower-cased; every supplementary character by itself."""
    def grams(run: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, n))

    def one(run: Column) -> Column:
        long = F.length(run) > 3
        cjk = F.when(long, grams(run, 3)).otherwise(F.array(run))
        if bigrams:
            cjk = F.when(F.length(run) >= 3, F.concat(cjk, grams(run, 2))).otherwise(cjk)
        return F.when(run.rlike(CJK_RUN), cjk).otherwise(F.array(fold_ascii(run)))

    # Most texts have word runs only: folded as a whole (all of it is ASCII by then), they need no step for each token. ASCII texts aren't searched for others.
    mixed = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(TOKEN_RUN), F.lit(0)), one))
    words = F.lower(F.array_join(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_-]+"), F.lit(0)), " "))
    plain = F.array_remove(F.split(words, " "), "")  # named once, so that it is searched once: a text without words gives one empty string
    return F.when((F.octet_length(c) != F.length(c)) & c.rlike(BEYOND_WORDS), mixed).when(c.isNotNull(), plain)


def query_tokens(c: Column) -> Column:
    """The query side never emits bigrams."""
    return tokenize(normalize_for_search(c), bigrams=False)


def corpus_tokens(c: Column) -> Column:
    return tokenize(normalize_for_search(c), bigrams=True)


def simplify_for_embedding(c: Column, simplify: tuple[str, str] | None) -> Column:
    return F.translate(c, *simplify) if simplify else c


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{3400}-\x{9FFF}]")


_NOISE = r"\||[\x{2500}-\x{259F}]+|\x{00B7}{2,}"


def has_denoisable(c: Column) -> Column:
    """Whether denoising would find a pipe, box or block drawing, or a run of dots."""
    return c.rlike(_NOISE)


def denoise(c: Column) -> Column:
    """Text for embedding: table dividers go; pipes, drawing characters and dot runs become blanks; blanks are folded, lines
    trimmed, and runs of empty lines become one, none at the ends."""
    divider = rf"^[{BLANK}]*\|[{BLANK}\-:|]+\|[{BLANK}]*$"
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(divider))
    lines = F.transform(lines, lambda x: trim_all(F.regexp_replace(F.regexp_replace(x, _NOISE, " "), r"[ \t]{2,}", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def strip_frontmatter(c: Column) -> Column:
    """Without a leading block between --- and the next ---."""
    end = F.locate("---", c, 4)
    return F.when(c.startswith("---") & (end > 0), trim_all(F.substr(c, end + 3))).otherwise(c)


def chunk_windows(df: DataFrame, body: str, title: str | None = None, size: int = 2000, overlap: int = 100) -> DataFrame:
    """Explode each row into (chunk_index, content): windows of size characters that share overlap ones, each after the title. An
    overlap of the size or more counts as none; an empty body gives the title alone."""
    step = size - (overlap if overlap < size else 0)
    n = F.length("_text")
    last = F.when(F.col(body).isNull(), F.lit(None)).when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    prefix = F.when(F.length(F.col(title)) > 0, F.concat(F.col(title), F.lit("\n"))).otherwise("") if title else F.lit("")
    out = df.withColumn("_text", F.coalesce(trim_all(F.col(body)), F.lit(""))).withColumn("_prefix", prefix)
    out = out.withColumn("_last", last).filter("_last IS NOT NULL").withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    content = F.when(F.length("_text") == 0, F.rtrim(F.regexp_replace("_prefix", r"\n$", ""))).otherwise(
        F.concat("_prefix", F.substr("_text", F.col("chunk_index") * step + 1, F.lit(size)))
    )
    return out.withColumn("content", content).drop("_text", "_prefix", "_last")


def chunk_title_prefix(title: Column, most: int | None = 64) -> Column:
    flat = F.regexp_replace(title, r"[\r\n]", " ")
    kept = F.substring(flat, 1, most) if most is not None else flat
    return F.when(F.length(F.coalesce(title, F.lit(""))) > 0, F.concat(kept, F.lit("\n"))).otherwise("")


def strip_chunk_prefix(content: Column, title: Column) -> Column:
    """The content without the title that chunking put before it, in any of the three ways it may have been written."""
    out = content
    plain = F.when(F.length(F.coalesce(title, F.lit(""))) > 0, F.concat(title, F.lit("\n"))).otherwise("")
    for prefix in reversed([chunk_title_prefix(title, 64), chunk_title_prefix(title, None), plain]):
        bare = F.substr(prefix, F.lit(1), F.length(prefix) - 1)
        out = (
            F.when(F.length(prefix) == 0, out).when(F.startswith(content, prefix), F.substr(content, F.length(prefix) + 1))
            .when(content == bare, F.lit("")).otherwise(out)
        )
    return out


def folder_of(path: Column) -> Column:
    """Up to the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/", 1)


def group_of(path: Column) -> Column:
    """The top-level folder, or / for a note at the top."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("/")


def basename_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")


def unwrap_wikilink(title: Column) -> Column:
    """[[target|shown]] to shown, [[folder/target]] to target."""
    inner = F.substr(title, F.lit(3), F.length(title) - 4)
    shown = F.when(F.contains(inner, F.lit("|")), F.regexp_extract(inner, r"^[^|]*\|(.*)$", 1)).otherwise(F.substring_index(inner, "/", -1))
    return F.when(title.startswith("[[") & title.endswith("]]"), shown).otherwise(title)


def note_title(frontmatter: Column, h1: Column, h1_unique: Column, path: Column) -> Column:
    """The frontmatter title, else a heading that no other note has, else the file's name."""
    some = lambda c: F.when(F.length(trim_all(c)) > 0, trim_all(c))
    return unwrap_wikilink(F.coalesce(some(frontmatter), F.when(h1_unique, some(h1)), basename_of(path)))


def first_h1(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit(""))


#: Characters that may end a whole sentence (fixed values).
SAFE_ENDINGS = "。！？.!?」』）\"'”’)…"


def is_legacy_truncated(c: Column) -> Column:
    """A description of 499 or 500 characters whose last one ends no sentence."""
    last = F.regexp_extract(c, f"(.)[{BLANK}]*$", 1)
    return F.length(c).isin(499, 500) & (F.length(last) > 0) & ~F.contains(F.lit(SAFE_ENDINGS), last)


def format_score(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit("–")).otherwise(F.format_string("%.2f", c))


def preview(description: Column, content: Column, most: int = 80) -> Column:
    """The description, or the first characters after the headings."""
    body = trim_all(F.regexp_replace(strip_frontmatter(content), r"(?m)^#{1,6}[ \t].*$", ""))
    return F.coalesce(F.when(F.length(trim_all(description)) > 0, description), F.substring(F.regexp_replace(body, f"[{BLANK}]+", " "), 1, most))


def parse_tags(c: Column) -> Column:
    """A comma-separated string to trimmed, non-empty tags."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_all), lambda x: F.length(x) > 0)


def clean_tags(c: Column) -> Column:
    """The same for tags that are an array already."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), trim_all), lambda x: F.length(x) > 0)


def coerce_tag_list(c: Column) -> Column:
    """Tags separated by blanks, commas or ideographic commas."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{BLANK},、，]+"), lambda x: F.length(x) > 0)


def pseudo_query(basename: Column, tags: Column) -> Column:
    """A note's keyword query: its tags in place of its name, if it has any."""
    return F.when(F.size(tags) > 0, F.array_join(tags, " ")).otherwise(basename)


def merge_tags(existing: Column, generated: Column) -> Column:
    """The existing tags and the generated ones that are new without regard to case; null if nothing is new."""
    have = F.transform(F.coalesce(existing, F.array().cast("array<string>")), F.lower)
    new = F.filter(generated, lambda x: ~F.array_contains(have, F.lower(x)))
    return F.when(F.size(new) > 0, F.concat(F.coalesce(existing, F.array().cast("array<string>")), new))


def title_starts_with(title: Column, phrase: str) -> Column:
    """Whether the title begins with the phrase, perhaps after a date."""
    t, p = trim_all(fold_ascii(title)), "".join(x.lower() if "A" <= x <= "Z" else x for x in phrase)
    dated = F.regexp_replace(t, r"^([0-9]{8}[-_ ]?|[0-9]{4}-[0-9]{2}-[0-9]{2}\s*)", "")
    return F.startswith(t, F.lit(p)) | F.startswith(dated, F.lit(p))


def has_heading_line(content: Column, phrase: str) -> Column:
    """A Markdown heading, outside code fences, that is the phrase."""
    folded = "".join(x.lower() if "A" <= x <= "Z" else x for x in phrase)
    bare = F.regexp_replace(fold_ascii(content), r"(?s)```.*?```", "")
    return bare.rlike(rf"(?m)^#{{1,6}}[^\S\n]+{re.escape(folded)}[^\S\n]*$")


def contains_phrase(content: Column, phrase: str) -> Column:
    """The phrase in the content; one word of ASCII must be a whole word."""
    p = "".join(x.lower() if "A" <= x <= "Z" else x for x in phrase)
    folded = fold_ascii(content)
    if not re.fullmatch(r"[a-z0-9_-]+", p):
        return F.contains(folded, F.lit(p))
    return folded.rlike(rf"(?<![{WORD}]){re.escape(p)}(?![{WORD}])")


def parse_verbatim_query(query: str) -> tuple[str, bool] | None:
    """The phrase of a query and whether it was quoted; null for less than two characters."""
    s = query.strip()
    quoted = len(s) >= 2 and s.startswith('"') and s.endswith('"')
    phrase = s[1:-1].strip() if quoted else s
    return (phrase, quoted) if len(phrase) >= 2 else None


def expand_query(query: str, synonyms: dict[str, list[str]] | None) -> str:
    """The query and the values of every synonym key it contains, each once."""
    fold = lambda x: x.replace("画", "划")
    q, extra = fold(query), []
    for key, values in (synonyms or {}).items():
        if key and fold(key) in q:
            extra += [v for v in values if v and fold(v) not in q and fold(v) not in map(fold, extra)]
    return " ".join([query, *extra]) if extra else query


_WIDE = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3100}-\x{312F}\x{3400}-\x{9FFF}\x{A000}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\p{IsHan}]"


def display_width(c: Column) -> Column:
    """Columns on the screen: wide characters take two."""
    return F.length(c) + F.length(F.regexp_replace(c, f"[^{_WIDE[1:-1]}]", ""))


def estimate_tokens(c: Column) -> Column:
    """A rough token count: letters and blanks 0.3, supplementary characters 2, others 1."""
    light = F.length(F.regexp_replace(c, r"[^A-Za-z \n\t]", ""))
    heavy = F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))
    return (F.length(c) - light - heavy) + light * F.lit(0.3) + heavy * F.lit(2.0)


#: Characters of a bare address: ASCII without blanks and controls.
_ADDRESS = r"[\x21-\x7E]"


def strip_urls(c: Column) -> Column:
    """Text for a language model. Rule: an image goes whole; of a link to the web or to the app its label stays; an address goes, be it in angle
    brackets, bare, or with its data in itself (type, parameters, a comma and the data, up to a quote, bracket, blank or a character beyond
    ASCII); then empty brackets, blanks at line ends and more than one empty line go."""
    bracketed, target = r"\[([^\]]*)\]", r"\([^)]*\)"
    linked = rf"!{bracketed}{target}|{bracketed}(?=\((?:https?|obsidian):){target}"
    c = F.regexp_replace(c, linked, "$2")  # an image has no second group
    kind = "(?:image|text|application|audio|video|font)"
    data = rf"[Dd][Aa][Tt][Aa]:{kind}/[\w.+-]+(?:;[\w=.+-]+)*,(?:(?![\"'>)]){_ADDRESS})*"
    c = F.regexp_replace(c, rf"<https?:[^>]*>|https?://{_ADDRESS}+", "")
    c = F.regexp_replace(F.regexp_replace(c, data, ""), r"\[\s*\]", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n)", ""), r"\n{3,}", "\n\n")


def strip_invisibles(c: Column, replacement: str = "") -> Column:
    """Without control and format characters, variation selectors and tag characters."""
    c = F.regexp_replace(c, r"[\p{Cc}\p{Cf}]", replacement)
    return F.regexp_replace(c, r"[\x{034F}\x{180B}-\x{180D}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}]", "")


def to_wikilink(path: Column) -> Column:
    return F.concat(F.lit("[["), F.regexp_replace(path, r"\.md$", ""), F.lit("]]"))


def markdown_safe(c: Column) -> Column:
    """A query as inline code, its fence longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), " ").otherwise("")
    return F.concat(F.lit("🔍 "), fence, pad, c, pad, fence)


def safe_basename(c: Column, most: int = 24) -> Column:
    """A query as a file name."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'[/\\:*?"<>|]', " "), r"[\p{Cc}\p{Cf}]", " "), r"^\.+", "")
    return F.coalesce(F.nullif(trim_all(F.substring(trim_all(bare), 1, most)), F.lit("")), F.lit("search"))


def djb2_hex(c: Column) -> Column:
    """The djb2 hash of a string's code points, as unsigned hexadecimal."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: F.length(x) > 0), lambda x: F.ascii(x))
    total = F.aggregate(points, F.lit(5381).cast("long"), lambda a, x: F.pmod(a * 33 + x, F.lit(1 << 32)))
    return F.lower(F.hex(total))


def title_boost(query: str, title: Column) -> Column:
    """0.25 for an equal title, 0.15 for one that contains the query, else 0.08 by the share of its words."""
    q = query.strip().lower()
    words = [w for w in re.split(r"\s+", q) if w]
    t = F.lower(trim_all(title))
    share = sum((F.contains(t, F.lit(w)).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    return F.when(t == q, 0.25).when(F.contains(t, F.lit(q)), 0.15).otherwise(share * 0.08) if q else F.lit(0.0)
