"""Text expressions (Column -> Column), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() separators that matter here: runs of ASCII white space.
WS = r"\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """``str.split()``: white-space separated words, empty pieces removed."""
    return F.filter(F.split(col(c), WS), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()`` (all white space, not only spaces like ``trim``)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def upper_first(c: Column | str) -> Column:
    """first letter upper-cased, the rest untouched (not ``initcap``)."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def lower_first(c: Column | str) -> Column:
    x = col(c)
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def question_from_prompt(prompt: Column | str) -> Column:
    """the question inside an evaluation prompt (4 layouts), lower-cased.

    ``OCR tokens: ... Question: <q> Short answer:``; a 3-line prompt with
    ``Reference OCR token: `` takes line 1 when it starts with that marker, else line 0;
    a 2-line prompt takes line 0; anything else is null.
    """
    p = col(prompt)
    lines = F.split(p, "\n", -1)
    n = F.size(lines)
    q = (
        F.when(p.startswith("OCR tokens: "), F.regexp_extract(p, r"(?s)Question: (.*?) Short answer:", 1))
        .when(p.contains("Reference OCR token: ") & (n == 3),
              F.when(p.startswith("Reference OCR token:"), F.get(lines, 1)).otherwise(F.get(lines, 0)))
        .when(n == 2, F.get(lines, 0))
    )
    return F.lower(q)


def url_dir(url: Column | str) -> Column:
    """the URL up to and including its last ``/``."""
    u = col(url)
    return F.regexp_extract(u, r"^(.*/)", 1)


def url_file(url: Column | str) -> Column:
    """the file part after the last ``/`` (query and fragment removed)."""
    return F.regexp_extract(F.regexp_replace(col(url), r"[?#].*$", ""), r"([^/]*)$", 1)


def short_name(path: Column | str) -> Column:
    """distinct non-numeric words of a file name (extension dropped), joined by ``-``."""
    base = F.regexp_replace(url_file(path), r"\.[^.]*$", "")
    ws = F.filter(F.split(base, r"[^A-Za-z0-9]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    return F.array_join(F.array_distinct(ws), "-")


def log_softmax_stats(logits: Column | str, label: Column | str) -> Column:
    """entropy of softmax(logits) and the log-probability of ``label``, with a
    max-shifted log-sum-exp."""
    x = col(logits)
    m = F.array_max(x)
    lse = m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m)))
    ent = lse - F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - lse) * v)
    return F.struct(ent.alias("entropy"), (F.get(x, col(label).cast("int")) - lse).alias("label_logprob"))
