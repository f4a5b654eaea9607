"""Text functions as columns: tokens, anchors, snippets, ids.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that define tokens and anchors.
TOKEN = r"([A-Za-z0-9_.%/-]+|[一-鿿]+)"
CLAUSE = r"(?<![0-9])([0-9]+(?:\.[0-9]+){1,3})(?:条)?"
TABLE = r"表\s*([0-9]+(?:\.[0-9]+)+)"
ALIAS = r"[一-鿿]+\s+([A-Za-z]+(?:[ -][A-Za-z]+)+)"
NUMERIC = r"(?i)([0-9]+(?:\.[0-9]+)?(?:%|MPa|天))"
NORMATIVE = r"不应|不得|应|宜|可"
ASSERTION = r"(?i)[0-9]|%|more|less|higher|lower|increase|decrease|because|therefore|due to|提高|降低|因此|导致"
CITATION = r"\[([0-9]+)\]"
WORD_PIECE = r"(?U)[\w一-鿿]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c) -> Column:
    """White space of any kind made single, and trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


#: White space of any kind but line ends, as in a class of a pattern and as characters.
BLANKS = r" \t\x0B\f\r\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """White space of any kind taken off both ends."""
    return F.btrim(col(c), F.lit(_SPACE))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_ingest(c) -> Column:
    """Text made fit for parsing: one kind of line end, words joined over a hyphen and line end, hard blanks and tabs plain,
    no blanks at line ends, at most two blank lines together.  Runs of blanks inside a line become one, but for table
    rows and what stands between code fences; blanks that set a line in stay.
    """
    plain_ends = lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    unbroken = lambda t: F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, r"(?U)(?<=\w)-\n(?=\w)", "")).otherwise(t)
    t = let(let(col(c), plain_ends), unbroken)
    t = F.replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), F.lit("\t"), F.lit("    "))
    t = F.regexp_replace(t, f"(?<![{BLANKS}])[{BLANKS}]++(?=\n|\\z)", "")
    fence = f"(?<![^\n])[{BLANKS}]*(?:```|~~~)[^\n]*"
    lead = f"^[{BLANKS}]*"
    line = lambda x: F.when(~F.contains(x, F.lit("  ")) | strip(x).rlike(r"^\|.*\|$"), x).otherwise(F.concat(F.regexp_extract(x, lead, 0), F.regexp_replace(F.regexp_replace(x, lead, ""), " {2,}", " ")))
    plain = lambda p: F.when(F.contains(p, F.lit("  ")), F.array_join(F.transform(F.split(p, "\n"), line), "\n")).otherwise(p)
    # parts between fences are outside and inside in turn; each fence stands after its part
    parts = lambda t, fences: F.array_join(F.transform(F.split(t, fence), lambda p, i: F.concat(F.when(i % 2 == 0, plain(p)).otherwise(p), F.coalesce(strip(F.get(fences, i)), F.lit("")))), "")
    fenced = lambda t: F.when(F.contains(t, F.lit("```")) | F.contains(t, F.lit("~~~")), let(F.regexp_extract_all(t, F.lit(fence), F.lit(0)), lambda f: parts(t, f))).otherwise(plain(t))
    return strip(F.regexp_replace(let(t, fenced), r"\n{4,}", "\n\n\n"))


def snippet(c, size: int = 180) -> Column:
    n = normalize(c)
    return F.when(F.length(n) <= size, n).otherwise(F.concat(F.rtrim(F.left(n, F.lit(size - 3))), F.lit("...")))


def odd_share(c) -> Column:
    """Share of characters that are neither letters, digits, blanks nor common punctuation; 1 for an empty text."""
    n = normalize(c)
    odd = F.regexp_replace(n, r"(?U)[\w\s.,:;!?/#()\[\]{}<>@'\"-]", "")
    return F.when(F.length(n) == 0, F.lit(1.0)).otherwise(F.length(odd) / F.length(n))


def garbled(c, threshold: float = 0.35) -> Column:
    return odd_share(c) >= threshold


def needs_ocr(c, least: int = 120, threshold: float = 0.35, lines: int = 3) -> Column:
    filled = F.size(F.filter(F.split(col(c), r"\R"), lambda x: F.trim(x) != ""))
    return (F.length(normalize(c)) < least) | garbled(c, threshold) | (filled < lines)


def _grams(run: Column) -> Column:
    """A run of ideographs: whole up to 4, else all pairs and triples, and whole up to 8."""
    n = F.length(run)
    some = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(run, i, F.lit(k)))
    return F.when(n <= 4, F.array(run)).otherwise(F.concat(some(2), some(3), F.when(n <= 8, F.array(run)).otherwise(F.array().cast("array<string>"))))


def search_tokens(c) -> Column:
    """Distinct search tokens: clause id, table ids, then words in lower case and ideograph grams, in order of appearance."""
    t = col(c)
    clause, table = F.regexp_extract(t, CLAUSE, 1), F.when(F.contains(t, F.lit("表")), F.regexp_extract(t, TABLE, 1)).otherwise("")
    none = F.array().cast("array<string>")
    first = F.concat(F.when(clause != "", F.array(clause)).otherwise(none), F.when(table != "", F.array(table, F.concat(F.lit("表"), table))).otherwise(none))
    runs = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[一-鿿]"), _grams(r)).otherwise(F.array(F.lower(r)))))
    words = F.when(t.rlike("[一-鿿]"), mixed).otherwise(F.transform(runs, F.lower))
    return F.coalesce(F.array_distinct(F.concat(first, words)), none)


def anchors(c) -> Column:
    """Regulation anchors of a text."""
    t = col(c)
    clause, table, alias = F.regexp_extract(t, CLAUSE, 1), F.regexp_extract(t, TABLE, 1), F.regexp_extract(t, ALIAS, 1)
    numeric = F.array_distinct(F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(1)))
    null = lambda x: F.nullif(x, F.lit(""))
    return F.struct(
        null(clause).alias("clause_id"), null(table).alias("table_id"), null(alias).alias("english_alias"),
        t.rlike(NORMATIVE).alias("is_normative"), numeric.alias("numeric_terms"), (F.size(numeric) > 0).alias("has_numeric"),
        ((clause != "") | (table != "") | (alias != "")).alias("is_anchor"),
    )


def word_pieces(c) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(col(c), F.lit(WORD_PIECE)))


def match_text(c) -> Column:
    """Letters and digits only, in lower case, for comparing a snippet with a text."""
    return F.lower(F.regexp_replace(normalize(c), r"(?U)[^\w一-鿿]+", ""))


def sentences(c) -> Column:
    """Parts between full-width or exclamation and question marks and line ends; ASCII full stops don't end one."""
    return F.filter(F.transform(F.split(col(c), r"[。！？!?]+|\n+"), lambda s: F.trim(s)), lambda x: x != "")


def slices(c, width: int = 120) -> Column:
    t = col(c)
    n = F.ceil(F.length(t) / width).cast("int")
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * width + 1, F.lit(width))))


def doc_key(kind: str, c) -> Column:
    return F.concat(F.lit("doc-"), F.left(F.sha1(F.concat(F.lit(kind + ":"), col(c)).cast("binary")), F.lit(16)))


def child_key(doc, block, parent, index, text) -> Column:
    part = F.left(F.sha1(col(text).cast("binary")), F.lit(12))
    return F.concat(F.lit("chunk-"), F.left(F.sha1(F.concat_ws(":", col(doc), col(block), col(parent), col(index), part).cast("binary")), F.lit(20)))


def clean_url(c) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash."""
    u = F.regexp_replace(col(c), r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([a-zA-Z]+://[^/?]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[a-zA-Z]+://[^/?]*", ""), r"/+$", "")
    return F.concat(head, rest)


def sanitize_citations(answer, n) -> Column:
    """Citations outside 1..n go; runs of blanks become one."""
    a = col(answer)
    wrong = F.filter(F.array_distinct(F.regexp_extract_all(a, F.lit(CITATION), F.lit(1))), lambda x: (x.cast("bigint") < 1) | (x.cast("bigint") > col(n)))
    return F.trim(F.regexp_replace(F.aggregate(wrong, a, lambda t, x: F.replace(t, F.concat(F.lit("["), x, F.lit("]")), F.lit(""))), " {2,}", " "))


def uncited(c) -> Column:
    """Sentences that assert something and cite nothing."""
    return F.filter(sentences(c), lambda x: x.rlike(ASSERTION) & ~x.rlike(CITATION))


def repaired(c) -> Column:
    """Sentences joined by blanks, those that assert without a citation ending in [1]."""
    return F.array_join(F.transform(sentences(c), lambda x: F.when(x.rlike(ASSERTION) & ~x.rlike(CITATION), F.concat(x, F.lit(" [1]"))).otherwise(x)), " ")
