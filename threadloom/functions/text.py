"""Text expressions that stay inside the JVM. Lengths and offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any Unicode kind, as Java's UNICODE_CHARACTER_CLASS has it.
SPACES = r"(?U)\s"


def utrim(c: Column) -> Column:
    """Trim white space of any Unicode kind from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


def clean_key(c: Column) -> Column:
    """An identifier, trimmed and in lower case; null where nothing is left."""
    return F.nullif(F.lower(utrim(c)), F.lit(""))


def token_estimate(c: Column) -> Column:
    """A third of the trimmed code points, rounded up; 0 for an empty text, null for null."""
    return F.ceil(F.length(utrim(c)) / 3).cast("int")


def rough_tokens(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def normalize_key(c: Column) -> Column:
    """Lower case; runs of what is no letter, digit or one of ``./@:+#`` become "-"; none at the ends. Null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(utrim(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{Nd}./@:+#]+", "-"), "^-+|-+$", "")


def normalize_space(c: Column) -> Column:
    """``normalize_key``, and "default" for an empty one."""
    return F.coalesce(F.nullif(normalize_key(c), F.lit("")), F.lit("default"))


def normalize_claim(c: Column) -> Column:
    """Lower case, runs of white space of any kind become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def project_space(path: Column) -> Column:
    """A project's name space from its path: lower case, "/" as "--", other signs as "-", "default" for nothing."""
    key = F.regexp_replace(F.lower(utrim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))), r"[^a-z0-9._/-]+", "-")
    key = F.regexp_replace(F.regexp_replace(F.replace(key, F.lit("/"), F.lit("--")), r"-{3,}", "-"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.lit("project:"), F.coalesce(F.nullif(key, F.lit("")), F.lit("default")))


#: Forms of secrets in texts.
SECRETS = (
    r"(?i)\b(?:api[_-]?key|access[_-]?token|secret|password)[\t\n\f\r ]*[:=][\t\n\f\r ]*[^\t\n\f\r ,;]+",
    r"(?i)\bbearer[\t\n\f\r ]+[a-z0-9._~+/=-]{12,}",
    r"\bsk-[A-Za-z0-9_-]{12,}\b",
    r"\bAKIA[A-Z0-9]{16}\b",
)


def redact_secrets(c: Column) -> Column:
    """Secrets masked by as many "*" as they have code points, so that offsets stay."""
    out = c
    for pattern in SECRETS:
        found = F.array_distinct(F.regexp_extract_all(out, F.lit(pattern), F.lit(0)))
        # the longest first, as one may begin another
        found = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
        out = F.aggregate(found, out, lambda text, secret: F.replace(text, secret, F.repeat(F.lit("*"), F.length(secret))))
    return out


def clamp(c: Column, limit: int) -> Column:
    """The first ``limit`` code points and "..." of a longer text."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def truncated(c: Column, tokens: int) -> Column:
    """The trimmed first three code points a token."""
    text = utrim(c)
    return F.when(F.length(text) <= 3 * tokens, text).otherwise(utrim(F.substring(text, 1, 3 * tokens)))


def excerpt(c: Column, limit: int, gap: str = "\n...\n") -> Column:
    """Both ends of a trimmed text over ``limit`` code points, with ``gap`` between them, in ``limit`` code points."""
    text = utrim(c)
    head = limit // 2
    tail = limit - head - len(gap)
    both = F.concat(utrim(F.substring(text, 1, head)), F.lit(gap), utrim(F.right(text, F.lit(tail)))) if tail >= 1 else utrim(F.substring(text, 1, limit))
    return F.when(F.length(text) <= limit, text).otherwise(both)


def hard_truncated(c: Column, limit: int) -> Column:
    """Half the limit from either end, with a notice of how much is gone between."""
    half = limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("\n\n... ["), (F.length(c) - limit).cast("string"), F.lit(" characters truncated] ...\n\n"), F.right(c, F.lit(half))))


def line_clamped(c: Column, limit: int) -> Column:
    """Each line cut to an equal share of the limit, 16 code points at least."""
    lines = F.split(c, "\n")
    share = F.greatest(F.lit(16), F.floor(F.lit(limit) / F.size(lines)).cast("int"))
    return F.when(F.length(c) <= limit, c).otherwise(F.array_join(F.transform(lines, lambda x: F.substr(x, F.lit(1), share)), "\n"))


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two), halves to even."""
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("bigint")))
        .when(c < 1024**2, F.format_string("%.1f KB", F.bround(c / 1024.0, 1)))
        .when(c < 1024**3, F.format_string("%.1f MB", F.bround(c / 1024.0**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(c / 1024.0**3, 2)))
    )


#: Curly quotes and what they become.
CURLY, STRAIGHT = "‘’‚‛“”„‟", "''''\"\"\"\""


def straight_quotes(c: Column) -> Column:
    return F.translate(c, CURLY, STRAIGHT)


def stripped_lines(c: Column) -> Column:
    """Without white space at the ends of lines."""
    return F.regexp_replace(c, r"[^\S\n]+(?=\n|$)", "")


#: Lines of installers, builds and progress bars that say nothing.
NOISE = (
    (r"(?m)^\s*Collecting\s+\S+", ""), (r"(?m)^\s*Downloading\s+\S+", ""), (r"(?m)^\s*Requirement already satisfied:.*", ""), (r"(?m)^\s*Installing collected packages:.*", ""),
    (r"(?m)^\s*npm\s+(install|run|build).*", ""), (r"(?m)^added \d+ packages.*", ""), (r"(?m)^\[\d+/\d+\].*(?:completed|done).*", ""), (r"(?m)^\s*\d+%\|[█▉▊▋▌▍▎▏ ]+\|.*", ""),
    (r"(?m)^\s*[a-f0-9]{12}: (Pull|Download|Extract).*", ""), (r"(?m)^\s*Status: Downloaded.*", ""), (r"(?m)^\s*Compiling\s+\S+", ""), (r"(?m)^\s*Checking\s+\S+", ""),
)


def snipped(c: Column) -> Column:
    """A tool result without installers' and builds' noise and without runs of blank lines."""
    out = c
    for pattern, put in NOISE:
        out = F.regexp_replace(out, pattern, put)
    return utrim(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


def sentences(c: Column) -> Column:
    """The sentences of a text: ended by ``.!?``, a line break or their full-width forms, trimmed, without empty ones."""
    marked = F.regexp_replace(c, r"([.!?。！？；\n]+)", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), utrim), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and "_"."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}_]+"), lambda t: t != "")


def _cut(t: Column, n: int) -> Column:
    return F.left(t, F.length(t) - n)


def singular(t: Column) -> Column:
    """The singular of a longer English token, else null."""
    n = F.length(t)
    return F.when(n <= 4, None).when(t.endswith("ies") & (n > 5), F.concat(_cut(t, 3), F.lit("y"))).when(t.rlike("(ses|xes|zes|ches|shes)$"), _cut(t, 2)).when(t.endswith("s") & ~t.endswith("ss"), _cut(t, 1))


def inflections(t: Column) -> Column:
    """Stems of a longer token in "ied", "ed" or "ing": bare, without a doubled last letter, with an "e"; of at least three letters."""
    n = F.length(t)
    single = lambda s: F.when(F.substring(s, -1, 1) == F.substring(s, -2, 1), _cut(s, 1)).otherwise(s)
    ied = F.array(F.concat(_cut(t, 3), F.lit("y")))
    ed = F.array(_cut(t, 2), single(_cut(t, 2)), _cut(t, 1))
    ing = F.array(_cut(t, 3), single(_cut(t, 3)), F.concat(_cut(t, 3), F.lit("e")))
    none = F.array().cast("array<string>")
    stems = F.when(n <= 4, none).when(t.endswith("ied") & (n > 5), ied).when(t.endswith("ed"), ed).when(t.endswith("ing"), ing).otherwise(none)
    return F.filter(stems, lambda s: (F.length(s) >= 3) & (s != t))


def query_tokens(c: Column, limit: int = 0) -> Column:
    """Distinct tokens in order, each followed by its singular and its stems; single ASCII letters are left out."""
    own = F.filter(tokens(c), lambda t: ~t.rlike("^[a-z]$"))
    every = F.flatten(F.transform(own, lambda t: F.concat(F.array(t), F.array_compact(F.array(singular(t))), inflections(t))))
    out = F.array_distinct(every)
    return F.slice(out, 1, limit) if limit else out


def literals(c: Column, limit: int = 8) -> Column:
    """What a query names exactly: quoted texts, paths, identifiers with a digit or "_", a lone UUID; normalized, distinct, in order."""
    quoted = F.regexp_extract_all(c, F.lit("[\"“”']([^\"“”']{2,})[\"“”']"), F.lit(1))
    paths = F.regexp_extract_all(c, F.lit(r"(?:[A-Za-z]:)?(?:[/~.][^\t\n\f\r ,，;；:：!?！？]+)+"), F.lit(0))
    ids = F.filter(F.regexp_extract_all(c, F.lit(r"\b[a-zA-Z][a-zA-Z0-9_-]{5,}\b"), F.lit(0)), lambda x: x.rlike("[_0-9]"))
    alone = F.regexp_replace(utrim(c), "^`+|`+$", "")
    uuid = F.when(alone.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.array(alone)).otherwise(F.array().cast("array<string>"))
    return normalized_list(F.concat(quoted, paths, ids, uuid), limit)


def fts_expression(terms: Column) -> Column:
    """Terms in double quotes, joined by OR."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def normalized_list(values: Column, limit: int = 0) -> Column:
    """Normalized values, distinct in order, without empty ones, ``limit`` at most."""
    out = F.array_distinct(F.filter(F.transform(values, normalize_claim), lambda v: v != ""))
    return F.slice(out, 1, limit) if limit else out


def ordered_distinct(values: Column) -> Column:
    """Trimmed values, distinct in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(values, utrim), lambda v: v != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def line_similarity(a: Column, b: Column) -> Column:
    """Words of the first that the second has, over the greater number of words (distinct ones in the second); 1 for equal lines."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    x, y = words(a), F.array_distinct(words(b))
    return F.when(a == b, 1.0).when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.greatest(F.size(x), F.size(y)))


def name_similarity(a: Column, b: Column) -> Column:
    """0.6 of the shared prefix over the longer name, and 0.4 of the shared letters over the greater number of distinct ones."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(x), F.length(y)))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))), i).otherwise(n))
    xs, ys = F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))
    common = F.size(F.array_intersect(xs, ys)) / F.greatest(F.size(xs), F.size(ys), F.lit(1))
    return F.when(x == y, 1.0).otherwise(F.when(longest == 0, 0.0).otherwise(same / longest) * 0.6 + common * 0.4)


def normalize_answer(c: Column) -> Column:
    """Lower case, ordinals without their endings, runs of anything but ASCII letters, digits and ideographs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(utrim(c)), r"\b([0-9]+)(?:st|nd|rd|th)\b", "$1"), "[^a-z0-9一-龥]+", " "))


#: Words that mean nothing in an answer, and what says that there is none.
STOPWORDS = ("a", "an", "and", "are", "as", "be", "is", "of", "on", "or", "the", "to", "was", "were", "with", "correct", "answer", "exactly", "select", "all", "that", "this")
UNCERTAIN = ("i don t know", "do not know", "cannot determine", "can t determine", "not enough information", "no specific", "unable to determine")


def uncertain(c: Column) -> Column:
    """A normalized answer that says it does not know."""
    return c.rlike("|".join(UNCERTAIN))


def loose_match(answer: Column, expected: Column) -> Column:
    """The expected phrase is in the answer, or enough of its meaningful tokens are: all of up to two, else six in ten. Both normalized."""
    words = F.filter(F.split(expected, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    have = F.split(answer, " ")
    hits = F.size(F.filter(words, lambda w: F.array_contains(have, w)))
    inside = F.contains(F.concat(F.lit(" "), answer, F.lit(" ")), F.concat(F.lit(" "), expected, F.lit(" ")))
    return F.when(expected == "", False).when(inside, True).when(F.size(words) == 0, False).when(F.size(words) <= 2, hits == F.size(words)).otherwise(hits / F.size(words) >= 0.6)


def ordinal(day: Column) -> Column:
    """A number with its English ordinal ending."""
    end = F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), end)


def date_forms(value: Column, event_time: Column) -> Column:
    """The ways to write a day in a text (lower case); without its year where the event's time implies it."""
    month, day, year = F.lower(F.date_format(value, "MMMM")), F.dayofmonth(value), F.year(value).cast("string")
    short, d, o, m = F.substring(month, 1, 3), day.cast("string"), ordinal(day), F.month(value)
    j = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    full = F.array(j(month, " ", d, ", ", year), j(month, " ", o, ", ", year), j(month, " ", d, " ", year), j(month, " ", o, " ", year), j(short, " ", d, ", ", year), j(short, " ", o, ", ", year), j(d, " ", month, " ", year), j(o, " ", month, " ", year),
                   j(m.cast("string"), "/", d, "/", year), F.date_format(value, "MM/dd/yyyy"), j(year, "-", m.cast("string"), "-", d), j(year, "年", m.cast("string"), "月", d, "日"))
    bare = F.array(j(month, " ", d), j(month, " ", o), j(short, " ", d), j(short, " ", o), j(d, " ", month), j(o, " ", month), j(m.cast("string"), "/", d), F.date_format(value, "MM/dd"), j(m.cast("string"), "月", d, "日"))
    same = F.try_make_timestamp(F.year(event_time), m, day, F.lit(0), F.lit(0), F.lit(0))
    implied = F.when(same > event_time + F.expr("interval 1 day"), F.year(event_time) - 1).otherwise(F.year(event_time)) == F.year(value)
    return F.when(F.coalesce(implied, F.lit(False)), F.concat(full, bare)).otherwise(full)


#: Parameters of a web address that only track.
TRACKERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


def canonical_url(c: Column) -> Column:
    """A web address with lower-case scheme and host, without fragment, trackers and trailing "/", parameters in order; empty where it is none."""
    parts = F.regexp_extract(utrim(c), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", 0)
    at = lambda i: F.regexp_extract(utrim(c), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    pairs = F.array_sort(F.filter(F.split(at(4), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKERS)))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(parts == "", "").otherwise(F.concat(F.lower(at(1)), F.lit("://"), F.lower(at(2)), F.regexp_replace(at(3), "/+$", ""), query))
