"""Text functions as column expressions: markup, tokens, titles, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: results depend on these exact words and patterns. ---
TEMPLATE_WORDS = """
describe bug steps reproduce expected behavior behaviour actual environment version additional context screenshots
description proposed solution checklist overview problem statement motivation related issue issues note notes
""".split()
STOP_WORDS = (
    """
the a an and or but if then than that this these those is are was were be been being to of in on at by for with from as
it its we i you they he she not no so do does did can could would should will when where which what how why all any each
more most other some such only own same up out about into over also there here has have had via use used using
""".split()
    + TEMPLATE_WORDS
)
SHORTEST, LONGEST = 3, 40
FENCE = r"(?i)```[a-z]*\n?"
COMMENT = r"(?s)<!--.*?-->"
LINK = r"!?\[([^\]]*)\]\([^)]*\)"
URL = r"https?://[^{space}]+"
WORDS = r"([A-Za-z_][A-Za-z0-9_.\-/]*|\d+\.\d+\.\d+)"
HUMP, ACRONYM = r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])"
PARTS = r"[\s_.\-/]+"
TITLE_PREFIX = r"^\w+(\([^)]*\))?:[{space}]*"
CALLER = r"[^\w.:-]"
# --- End of fixed values. ---

#: White space as web text means it; the regular expression classes of the JVM and RE2 know ASCII only.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
URL = URL.replace("{space}", SPACE)
#: What a token must have to fall into parts at HUMP, ACRONYM or PARTS.
SPLITS = r"[_.\-/]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
TITLE_PREFIX = TITLE_PREFIX.replace("{space}", SPACE)


def strip_markup(text: Column) -> Column:
    """Code-fence openers, comments and URLs become blanks; links become their text."""
    t = F.regexp_replace(text, FENCE, " ")
    t = F.regexp_replace(t, COMMENT, " ")
    t = F.regexp_replace(t, LINK, "$1")
    return F.regexp_replace(t, URL, " ")


def expand_identifier(token: Column) -> Column:
    """The token, and its parts at humps and punctuation if at least two are longer than 2."""
    humps = F.regexp_replace(F.regexp_replace(token, HUMP, "$1 $2"), ACRONYM, "$1 $2")
    parts = F.filter(F.split(humps, PARTS), lambda p: F.length(p) > 2)
    split = F.when(F.size(parts) > 1, F.concat(F.array(token), parts)).otherwise(F.array(token))
    return F.when(token.rlike(SPLITS), split).otherwise(F.array(token))  # most tokens have one part


def tokenize(text: Column) -> Column:
    """Lower-case tokens in order, repeats kept; null gives none."""
    rough = F.regexp_extract_all(strip_markup(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(1))
    low = F.transform(F.flatten(F.transform(rough, expand_identifier)), F.lower)
    good = lambda t: F.length(t).between(SHORTEST, LONGEST) & ~t.isin(STOP_WORDS) & ~t.rlike(r"^\d+\z")
    return F.filter(low, good)


def counted(s: Column) -> Column:
    """(term, n) structs of a sorted array's distinct values, by cutting runs: linear, and no shuffle.

    ``s`` must be a column of its own (not an expression): lambdas read it once an element.
    """
    first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    upto = F.concat(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), F.array(F.size(s) + 1))
    runs = F.zip_with(first, upto, lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (b - a).cast("long").alias("n")))
    return F.when(F.size(s) > 0, runs).otherwise(F.array().cast("array<struct<term:string,n:bigint>>"))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]+", " "), r"^ | \z", "")


def embed_text(title: Column, body: Column, cap: int = 2000) -> Column:
    """Title twice, then the plain body up to ``cap`` characters."""
    return F.concat_ws("\n", title, title, F.substring(collapse_space(strip_markup(F.coalesce(body, F.lit("")))), 1, cap))


def norm_title(title: Column) -> Column:
    """Without one leading ``word(scope):``, lower-case, trimmed."""
    t = F.lower(F.regexp_replace(title, TITLE_PREFIX, ""))
    return F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def jaccard(a: Column, b: Column) -> Column:
    """Index of two arrays as sets; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(inter / F.size(F.array_union(a, b)))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ago(then: Column, now: Column) -> Column:
    """"5m ago", from timestamps."""
    m = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60000.0 + 0.5)
    hours, days = F.floor(m / 60.0 + 0.5), F.floor(m / 1440.0 + 0.5)
    return (
        F.when(then.isNull(), "never")
        .when(m < 1, "just now")
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(m < 48 * 60, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def caller_id(raw: Column) -> Column:
    return F.regexp_replace(F.substring(raw, 1, 64), CALLER, "_")


def stamps(ts: Column) -> dict[str, Column]:
    """UTC day, hour and month keys; the session's time zone must be UTC."""
    return {"day": F.date_format(ts, "yyyyMMdd"), "hour": F.date_format(ts, "yyyyMMddHH"), "month": F.date_format(ts, "yyyyMM")}


def state_label(state: Column, merged: Column) -> Column:
    return F.when(state == "OPEN", "open").when(F.coalesce(merged, F.lit(False)), "merged").otherwise("closed")


def clean_paths(lines: Column) -> Column:
    """Paths of a pasted list: trimmed, without diff prefixes a/ and b/, empty ones dropped."""
    each = F.transform(F.split(lines, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", ""), "^[ab]/", ""))
    return F.filter(each, lambda x: x != "")


def capped_input(title: Column, body: Column, files: Column) -> dict[str, Column]:
    """What a request may carry: 200 and 4000 characters, 60 paths."""
    return {"title": F.substring(title, 1, 200), "body": F.substring(body, 1, 4000), "files": F.slice(files, 1, 60)}
