"""Column functions over text, paths, addresses and recorded replies. Unless said otherwise a null gives a null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "the and for with that this from into over under your their there here have has had will would could "
    "should what when where which while who whom whose about than then also only just into onto were been"
).split()
DECLINED = (
    r"(?i)couldn.t find|could not find|unable to find|cannot find|not enough information|no information|"
    r"do(es)? not (state|mention|specify|provide|say|list|give)|not (stated|specified|mentioned|provided|listed|given) in|"
    r"cannot (answer|determine)|can.t (answer|determine)"
)
THINK = r"(?i)</?think>"
TABLE_ROW = r"^\s*\|.*\|\s*$"
STEP = r"^\s*(\(?\d{1,2}[.)]|[Ss][Tt][Ee][Pp]\s+\d+|[a-h][.)])\s+\S"
META_PHRASES = r"(?i)\b(document collection|the collection|the library|in the context of|documents?)\b"
FILLER = r"(?i)\b(more information|tell me|can you|please)\b"
WELL_KNOWN_SIDS = ("s-1-1-0", "s-1-5-11", "s-1-5-32-545")
GRADES = {"C": "correct", "C-": "partial", "A": "abstained", "N": "wrong", "W": "wrong"}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def tokenise(c: Column) -> Column:
    """Lower-case tokens; one with - . or / in it is followed by its parts."""
    plain = F.translate(F.regexp_replace(F.lower(c), "<[^>]*>", " "), "*_|", "   ")
    tokens = F.regexp_extract_all(plain, F.lit(r"[a-z0-9][a-z0-9\-./]*[a-z0-9]|[a-z0-9]"), F.lit(0))
    parted = F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("[-./]"), F.concat(F.array(t), F.filter(F.split(t, "[-./]"), lambda x: x != ""))).otherwise(F.array(t))))
    return F.when(plain.rlike(r"[a-z0-9][\-./]+[a-z0-9]"), parted).otherwise(tokens)  # few lines have a token of parts


def overlap_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of three characters and more that aren't stopwords."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def overlap_score(a: Column, b: Column) -> Column:
    """Shared tokens by the geometric mean of both sizes; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double"))).otherwise(0.0)


def normalised(c: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")))


def solid_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\r\n|\r|\n"), lambda x: x.rlike(r"\S"))


def has_row(c: Column) -> Column:
    """Whether any line is a table row."""
    return F.exists(F.split(c, "\r\n|\r|\n"), lambda x: x.rlike(TABLE_ROW))


def continues(a: Column, b: Column) -> Column:
    """Whether a's last or b's first solid line is a table row or a numbered step."""
    cut = lambda x: F.coalesce(x.rlike(TABLE_ROW) | x.rlike(STEP), F.lit(False))
    return cut(F.try_element_at(solid_lines(a), F.lit(-1))) | cut(F.try_element_at(solid_lines(b), F.lit(1)))


def basename(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"[^/\\]*$", 0))


def excluded_keys(names: Column) -> Column:
    """The names and their base names, lower-case."""
    return F.array_distinct(F.concat(F.transform(names, F.lower), F.transform(names, basename)))


def display_name(source_path: Column, filename: Column) -> Column:
    return F.when(F.coalesce(source_path, F.lit("")) != "", source_path).otherwise(F.regexp_extract(F.replace(filename, F.lit("\\"), F.lit("/")), "[^/]*$", 0))


def category(name: Column) -> Column:
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("uncategorised")


def path_level(path: Column, level: int) -> Column:
    """The folder of a level (0: category, 1: vendor, 2: family) of a path; empty if it is shallower."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > level + 1, F.get(parts, F.lit(level))).otherwise("")


def join_original_path(base: Column, path: Column) -> Column:
    """base and path joined in base's style: with a backslash in it, all separators are."""
    base, path = F.regexp_replace(trimmed(base), r"[/\\]+$", ""), F.regexp_replace(trimmed(path), r"^[/\\]+", "")
    windows = F.contains(base, F.lit("\\"))
    return F.when(base == "", path).when(path == "", base).when(windows, F.concat(base, F.lit("\\"), F.replace(path, F.lit("/"), F.lit("\\")))).otherwise(F.concat(base, F.lit("/"), path))


def upload_root(original: Column, path: Column) -> Column:
    """What original has before path, in either style; empty if it doesn't end with it."""
    original, path = trimmed(original), F.regexp_replace(trimmed(path), r"^[/\\]+|[/\\]+$", "")
    out = F.lit("")
    for styled in (F.replace(path, F.lit("\\"), F.lit("/")), F.replace(path, F.lit("/"), F.lit("\\"))):
        for sep in ("/", "\\"):
            tail = F.concat(F.lit(sep), styled)
            fits = (path != "") & F.endswith(original, tail) & (F.length(original) > F.length(tail))
            out = F.when(fits, F.substring(original, F.lit(1), F.length(original) - F.length(tail))).otherwise(out)
    return out


def folder_path(path: Column) -> Column:
    clean = F.regexp_replace(F.replace(trimmed(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when(F.contains(clean, F.lit("/")), F.regexp_extract(clean, "^(.*)/[^/]*$", 1)).otherwise("")


def canonical_unc(c: Column, aliases: Column | None = None) -> Column:
    r"""\\host\share\... in lower case; null unless c has at least host and share. aliases: a map of host names."""
    path = F.replace(F.regexp_replace(trimmed(c), r"(?i)^\\\\\?\\UNC\\", r"\\\\\\\\"), F.lit("/"), F.lit("\\"))
    parts = F.filter(F.split(F.lower(path), r"\\"), lambda x: x != "")
    host = F.get(parts, F.lit(0))
    if aliases is not None:
        host = F.coalesce(F.try_element_at(aliases, host), host)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.startswith(path, F.lit("\\\\")) & (F.size(parts) >= 2), F.concat(F.lit("\\\\"), F.array_join(F.concat(F.array(host), rest), "\\")))


def given(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sid_to_principal(sid: Column) -> Column:
    """A cloud SID's four little-endian numbers as an object id; * for groups that hold everyone; else null."""
    low = F.lower(trimmed(sid))
    numbers = F.transform(F.split(F.regexp_extract(low, "^s-1-12-1-(.*)$", 1), "-"), lambda x: x.try_cast("long"))
    fits = low.rlike(r"^s-1-12-1-[0-9]{1,10}(-[0-9]{1,10}){3}$") & F.forall(numbers, lambda x: x <= 0xFFFFFFFF)
    byte = lambda n, k: F.lower(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0"))
    little = given(F.array_join(F.transform(numbers, lambda n: F.concat(*[byte(n, k) for k in range(4)])), ""), lambda x: x)
    at = lambda h, *ks: F.concat(*[F.substring(h, 2 * k + 1, 2) for k in ks])
    made = given(little, lambda h: F.concat_ws("-", at(h, 3, 2, 1, 0), at(h, 5, 4), at(h, 7, 6), at(h, 8, 9), at(h, *range(10, 16))))
    return F.when(low.isin(*WELL_KNOWN_SIDS), "*").when(fits, made)


def principal_to_sid(oid: Column) -> Column:
    """The inverse: an object id's cloud SID."""
    number = lambda h, *at: F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in at]), 16, 10)
    made = lambda h: F.concat_ws("-", F.lit("S-1-12-1"), number(h, 0, 1, 2, 3), number(h, 6, 7, 4, 5), number(h, 11, 10, 9, 8), number(h, 15, 14, 13, 12))
    return given(F.replace(F.lower(oid), F.lit("-")), made)


def clean_url(url: Column) -> Column:
    """Empty unless http or https; without x-sign parameters, else as it was."""
    trim = trimmed(F.coalesce(url, F.lit("")))
    part = lambda k: F.regexp_extract(trim, r"^([^?#]*)\?([^#]*)(.*)$", k)
    kept = F.array_join(F.filter(F.split(part(2), "&"), lambda x: ~x.rlike("(?i)^x-sign(=|$)")), "&")
    bare = F.concat(part(1), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), part(3))
    return F.when(~trim.rlike("(?i)^https?://"), "").when(trim.rlike(r"(?i)^[^?#]*\?([^#]*&)?x-sign="), bare).otherwise(trim)


def redacted(c: Column, rented: tuple[str, ...] = ()) -> Column:
    """Without user names in addresses, and without what names a machine in hosts that are rented: in `<name>-<port>.<domain>` for each of the rented domains."""
    bare = F.regexp_replace(c, r"(?i)(https?://)[^/\s@]+@", "$1<redacted>@")
    if not rented:
        return bare
    domains = "|".join(map(re.escape, rented))
    return F.regexp_replace(bare, rf"(?i)(?<![\w.-])[a-z0-9-]+(-\d+\.(?:{domains}))\b", "<pod-id>$1")


def host_of(url: Column, rented: tuple[str, ...] = ()) -> Column:
    """Host and port of an address, redacted."""
    return redacted(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), rented)


def masked(c: Column) -> Column:
    """struct(text, replacements): identifiers in lines that speak of what they identify, then home folders."""
    ids = {
        r"(?i)pod|proxy|session": (r"\b(?=[a-z0-9]*\d)(?=[a-z0-9]*[a-z])[a-z0-9]{14}\b", "<pod-id>"),
        r"(?i)volume": (r"\b(?=[a-z0-9]*\d)(?=[a-z0-9]*[a-z])[a-z0-9]{10}\b", "<volume-id>"),
    }
    row = lambda text, n: F.struct(text.alias("text"), n.alias("n"))
    lines = F.transform(F.split(c, "\n", -1), lambda x: row(x, F.lit(0)))

    def masking(context: str, pattern: str, mask: str):
        return lambda x: F.when(x["text"].rlike(context), row(F.regexp_replace(x["text"], pattern, mask), x["n"] + F.regexp_count(x["text"], F.lit(pattern)))).otherwise(x)

    for context, (pattern, mask) in ids.items():
        lines = F.transform(lines, masking(context, pattern, mask))
    text, n = F.array_join(F.transform(lines, lambda x: x["text"]), "\n"), F.aggregate(lines, F.lit(0), lambda s, x: s + x["n"])
    for pattern, mask in ((r"/home/[a-z_][a-z0-9_-]*", "~"), (r"""(?i)C:\\+Users\\+[^\\\s"'`]+""", "%USERPROFILE%")):
        n, text = n + F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, mask)
    return row(text, n)


def is_declined(answer: Column, citations: Column) -> Column:
    return (citations == 0) & F.coalesce(answer, F.lit("")).rlike(DECLINED)


def think_residue(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(THINK)


def thinking(request: Column, answer_request: Column) -> Column:
    """on, off or unset by a flag in two JSON bodies; the answer's wins."""
    flag = lambda c: F.get_json_object(c, "$.chat_template_kwargs.enable_thinking")
    found = F.coalesce(flag(answer_request), flag(request))
    return F.when(found == "true", "on").when(found == "false", "off").otherwise("unset")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unfenced(reply: Column) -> Column:
    """A reply without code fences around it."""
    return F.regexp_replace(trimmed(reply), r"^```[A-Za-z]*\s*|\s*```$", "")


def parsed(reply: Column, schema: str) -> Column:
    """A reply's JSON by schema; null fields where it can't be parsed."""
    return F.from_json(unfenced(reply), schema)


def word_count(c: Column) -> Column:
    """Token counter: words parted by white space."""
    return F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+"))


def expanded_ids(cell: Column) -> Column:
    """Ids of a grade table's cell, ranges expanded; null if any part is malformed."""
    parts = F.transform(F.split(cell, ","), trimmed)
    pattern = r"^([A-Z])(\d{2})\s*[–-]\s*([A-Z]?)(\d{2})$"
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    one = lambda x: F.when(x.rlike(r"^[A-Z]\d{2}$"), F.array(x)).when(
        x.rlike(pattern) & part(x, 3).isin("", part(x, 1)) & (part(x, 2).try_cast("int") <= part(x, 4).try_cast("int")),
        F.transform(F.sequence(part(x, 2).try_cast("int"), F.greatest(part(x, 2).try_cast("int"), part(x, 4).try_cast("int"))), lambda n: F.concat(part(x, 1), F.lpad(n.cast("string"), 2, "0"))),
    )
    made = F.transform(parts, one)
    return F.when(~F.exists(made, lambda x: x.isNull()), F.flatten(made))


def parsed_grade(cell: Column) -> Column:
    """struct(grade, count, label) of a grade cell; null grade if malformed."""
    text = trimmed(F.replace(cell, F.lit("*")))
    pattern = r"^(C-|C|A|N|W)(?:\s*[×x]\s*(\d+))?$"
    grade = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    labels = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    return F.struct(grade.alias("grade"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("count"), F.try_element_at(labels, grade).alias("label"))


def normalised_folder(path: Column) -> Column:
    """Trimmed segments joined by /; null if one is a dot segment, has a control character, or all are over 1024 long."""
    parts = F.filter(F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), trimmed), lambda x: x != "")
    bad = F.exists(parts, lambda x: x.isin(".", "..") | x.rlike(r"[\x00-\x1f]"))
    joined = F.array_join(parts, "/")
    return F.when(~bad & (F.length(joined) <= 1024), joined)


def sanitised_path(path: Column) -> Column:
    """An upload path without root, dot and empty segments; null if nothing is left."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def rewrite_flags(query: Column, rewritten: Column, mode: Column) -> Column:
    """Failure shapes of a rewritten query."""
    flags = F.array(
        F.when((mode != "library") & rewritten.rlike(META_PHRASES), "META"),
        F.when(rewritten.rlike(FILLER), "FILLER"),
        F.when(F.contains(F.lower(query), F.lit("hmis")) & F.contains(rewritten, F.lit("HMIS")), "ACRONYM"),
    )
    return F.array_compact(flags)


def headings(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), F.lit(1)), trimmed)


def tables(text: Column) -> Column:
    """Runs of lines that begin and end with a bar."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)((?:^\|.*\|[ \t]*$\n?)+)"), F.lit(1)), trimmed)


def needs_ocr(text: Column, least: int = 50) -> Column:
    return F.length(trimmed(F.coalesce(text, F.lit("")))) < least
