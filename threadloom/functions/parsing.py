"""Text out of marked-up or structured text, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references of HTML that are resolved.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_title(c: Column) -> Column:
    """The text of the first title, without white space at its ends; empty without one."""
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column) -> Column:
    """The readable text: without scripts, styles, comments and tags, block ends as line breaks, references resolved, white space squeezed."""
    out = F.regexp_replace(c, r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|h[1-6]|li|tr)>|<br[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n"))


def judged(c: Column) -> Column:
    """``is_correct`` of a judge's answer: JSON in a fence, or anywhere in the text; null where there is none."""
    inside = F.regexp_extract(c, r"(?s)(\{[^{}]*\"is_correct\"[^{}]*\})", 1)
    return F.from_json(inside, "is_correct boolean")["is_correct"]


def metric(c: Column, name: str) -> Column:
    """The number after ``name:`` in a report; null without it."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, rf"(?im)^\s*{name}\s*[:=]\s*([0-9]+\.[0-9]+)", 1), F.lit("")), F.lit("999.999999")).cast("double")


#: Commands that only read, and what makes a command dangerous or in need of leave.
READS = ("ls", "cat", "grep", "head", "tail", "wc", "pwd", "echo", "find", "which", "date", "whoami", "stat", "diff", "sort", "uniq")
READING = ("git status", "git log", "git diff", "git show", "git branch", "go vet", "go version", "npm ls")


def command_risk(c: Column) -> Column:
    """safe, needs permission or dangerous, of a shell command: the worst of its pipeline's parts; anything that is not known to read needs leave."""
    parts = F.transform(F.split(F.trim(c), r"\|\|?|&&|;"), lambda p: F.trim(p))
    first = lambda p: F.substring_index(p, " ", 1)
    two = lambda p: F.substring_index(p, " ", 2)
    dangerous = c.rlike(r"(^|[\s|;&])(sudo|doas|mkfs\S*|dd)\b|\brm\s+-\w*[rf]|\$\(|`|>\s*/dev/|\bIFS=")
    writes = c.rlike(r">")
    safe = F.forall(parts, lambda p: first(p).isin(*READS) | two(p).isin(*READING))
    return F.when(dangerous, "dangerous").when(safe & ~writes, "safe").otherwise("needs permission")


def quote_start(source: Column, quote: Column) -> Column:
    """Where a quote stands in a source, from 0: word for word, else in lower case with runs of white space as one (in the source read so); -1 where it does not."""
    flat = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " "))
    plain = F.position(quote, source)
    return F.when(plain > 0, plain - 1).otherwise(F.position(F.trim(flat(quote)), flat(source)) - 1).cast("int")
