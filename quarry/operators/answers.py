"""Answers: citations, snippets, evidence for decisions, enumerations."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import ENDS, collapse, strip, truncate

_CHUNK, _HANDLE = re.compile(r"chunk_id:\s*([A-Za-z0-9_-]+)"), re.compile(r"\[ID:(\d+)\]")
_GROUP = re.compile(r"\[\s*ID\s*:\s*[0-9]+(?:\s*,\s*ID\s*:\s*[0-9]+)+\s*\]")
#: Fixed values, in characters: texts shown whole, scattered hits shown whole, a window, its least context, what a sentence's end may add; the share that counts as whole.
WHOLE, SCATTERED, WINDOW, CONTEXT, TOLERANCE, NEARLY = 600, 3000, 1200, 240, 240, 0.9


# ---------------------------------------------------------------- citations


def cited_chunks(answer: Column) -> Column:
    """Chunk ids that an answer names, first seen first."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(_CHUNK.pattern), F.lit(1)))


def mark_line(line: str, place: dict[str, int]) -> str:
    """A line with the marks of the chunks it names, behind its last back-tick or its last id; a line with marks stays."""
    named = list(_CHUNK.finditer(line))
    numbers = dict.fromkeys(place[m[1]] for m in named if m[1] in place)
    if not numbers or "[ID:" in line:
        return line
    at = max(named[-1].end(), line.rfind("`") + 1)
    return line[:at] + "".join(f" [ID:{n}]" for n in numbers) + line[at:]


def expand_group(answer: str, n_handles: int) -> str:
    """Marks that name several handles as one mark each; handles that are not published go."""
    if n_handles <= 0:
        return answer
    return _GROUP.sub(lambda m: "".join(f"[ID:{n}]" for n in map(int, re.findall("[0-9]+", m[0])) if n < n_handles), answer)


def resolve(answer: str, ids: list[str], published: list[str]) -> tuple[str, list[str]]:
    """An answer whose handles (places in ``ids``) are places in ``published``, and the ids cited, first seen first; other handles go."""
    place = {i: k for k, i in reversed(list(enumerate(published)))}
    known = lambda m: ids[int(m[1])] if int(m[1]) < len(ids) and ids[int(m[1])] in place else None
    cited = list(dict.fromkeys(i for m in _HANDLE.finditer(answer) if (i := known(m)) is not None))
    return _HANDLE.sub(lambda m: f"[ID:{place[i]}]" if (i := known(m)) is not None else "", answer), cited


@F.pandas_udf(T.StringType())
def insert_markers(answer: pd.Series, ids: pd.Series) -> pd.Series:
    """Answers with a mark for every chunk id of a list, line by line."""
    return pd.Series(["\n".join(mark_line(line, {i: k for k, i in reversed(list(enumerate(own)))}) for line in (a or "").split("\n")) for a, own in zip(answer, ids, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("cited", T.ArrayType(T.StringType()))]))
def compact_citations(answer: pd.Series, ids: pd.Series, published: pd.Series) -> pd.DataFrame:
    rows = [resolve(expand_group(a or "", len(i)), list(i), list(p)) for a, i, p in zip(answer, ids, published, strict=True)]
    return pd.DataFrame(rows, columns=["answer", "cited"])


# ---------------------------------------------------------------- snippets


def _flat(text: str) -> str:
    return re.sub(" {2,}", " ", text.replace("\n", " ")).strip()


def _cut(text: str, start: int, end: int) -> tuple[str, bool]:
    start, end = max(start, 0), min(end, len(text))
    return ("..." if start else "") + _flat(text[start:end]) + ("..." if end < len(text) else ""), start > 0 or end < len(text)


def term_span(text: str, wanted: list[str]) -> tuple[int, int] | None:
    """From the first to the last occurrence of any of the terms, whatever their case."""
    found = [m.span() for t in wanted if t for m in re.finditer(re.escape(t.lower()), text.lower())]
    return (min(s for s, _ in found), max(e for _, e in found)) if found else None


def _words_from(text: str, at: int) -> int:
    """A place, or from within a word the first beginning of a word behind it, if there is one."""
    if at <= 0 or at >= len(text) or text[at - 1].isspace():
        return min(max(at, 0), len(text))
    return next((m.end() for m in re.compile(r"\s+").finditer(text, at)), at)


def _window(text: str, first: int, last: int) -> tuple[int, int]:
    """Where the part of a text begins and ends that shows the hits from ``first`` to ``last``.

    A text of few characters is its own window, and of more if the hits lie far apart; hits too far apart for a window show where they begin. Otherwise it is their paragraph, or, of
    the places where sentences meet, the first within the context before the hits and the first behind the context after them.
    """
    if len(text) <= (SCATTERED if last - first >= WINDOW else WHOLE):
        return 0, len(text)
    if last - first >= WINDOW:
        return first, first + WINDOW
    above = text[:first].rpartition("\n\n")
    opening = 1 if not above[1] and text[:1] == "\n" and first else 0  # a text's first line feed ends a blank line
    paragraph = first - len(above[2]) + opening, last + len(text[last:].partition("\n\n")[0])
    if paragraph[1] - paragraph[0] <= WINDOW:
        return paragraph
    meets = [m.end() for m in re.finditer(f"[{ENDS};]", text)]
    inner = [m for m in meets if m < len(text)]

    def begin(at: int) -> int:
        """The first meeting of sentences from ``at`` on, or ``at`` where none follows."""
        return next(iter(inner[bisect_left(inner, at) :]), at)

    near = _words_from(text, first - CONTEXT)
    start = begin(near)
    if start > first:
        start = max((m for m in meets if m <= near), default=0)
    reach = min(last + CONTEXT, len(text))
    aligned = next(iter(meets[bisect_right(meets, reach) :]), len(text))
    end = aligned if aligned - start <= WINDOW + TOLERANCE else reach
    if end - start > WINDOW:
        late = max(end - WINDOW, first)
        start = _words_from(text, late) if late > start else start
        start = begin(start) if begin(start) <= first else start
    return (0, len(text)) if end - start >= NEARLY * len(text) else (start, end)


def snippet(text: str, first: int, last: int) -> tuple[str, bool]:
    """What is shown of a text around its hits, and whether something was left out."""
    if first >= len(text):
        return "", False
    first, last = sorted((max(first, 0), max(last, 0)))
    start, end = _window(text, first, min(max(last, first + 1), len(text)))
    if (start, end) == (0, len(text)):
        return _flat(text), False
    return _cut(text, start, end)[0], start > 0 or end < len(text)


def preview(text: str) -> tuple[str, bool]:
    """What is shown of a text without a hit: all of a short one, else its beginning."""
    return (_flat(text), False) if len(text) <= WHOLE else (_cut(text, 0, WINDOW)[0], True)


@F.pandas_udf(T.StructType([T.StructField("snippet", T.StringType()), T.StructField("truncated", T.BooleanType())]))
def snippets(text: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """For texts and lists of terms."""
    rows = []
    for t, own in zip(text.fillna(""), wanted, strict=True):
        span = term_span(t, list(own))
        rows.append(snippet(t, *span) if span else preview(t))
    return pd.DataFrame(rows, columns=["snippet", "truncated"])


# ---------------------------------------------------------------- evidence


def decision_state(ranked: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """``group, state``: passages (``group, rank, text``) from the first on, as many whole ones as fit with two line feeds between; a first one that does not fit is cut."""
    body = strip(F.col("text"))
    rows = ranked.where(body != "").withColumn("t", body)
    order = Window.partitionBy(group).orderBy("rank")
    upto = F.sum(F.octet_length("t") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 2
    rows = rows.withColumns({"n": F.row_number().over(order), "upto": upto}).where((F.col("upto") <= budget) | (F.col("n") == 1))
    shown = F.when(F.col("upto") <= budget, F.col("t")).otherwise(F.left("t", F.lit(budget)))
    kept = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("t")))).alias("p"))
    return kept.select(group, F.array_join("p.t", "\n\n").alias("state"))


def extractive_answer(ranked: DataFrame, most: int = 6, chars: int = 400, group: str = "query_id") -> DataFrame:
    """``group, answer``: the first passages, numbered."""
    rows = ranked.where(F.col("rank") <= most).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", truncate(collapse(F.col("text")), chars, "…").alias("t")))).alias("p"))
    return rows.select(group, F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n").alias("answer"))


# ---------------------------------------------------------------- enumerations

#: Kinds of slots whose answer is a set, and those that name what its elements are.
SETS, KINDS = ("count", "set", "list"), ("entity", "person", "dataset", "list", "set")


def unique_values(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of each key without blank ones, and of those equal but for case the first."""
    v = rows.withColumn(value, strip(F.col(value))).where(F.col(value) != "")
    return v.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.lower(value)).orderBy(order))).where("_n = 1").drop("_n")


def coverage_gate(slots: DataFrame) -> DataFrame:
    """``query_id, asks``: whether the slots (``query_id, at, type, subject, terms``) ask for a set, of elements, with words for what they did."""
    kind = F.lower(strip(F.col("type")))
    acts = F.size(F.filter("terms", lambda t: strip(t) != "")) > 0
    return slots.groupBy("query_id").agg((F.max(kind.isin(*SETS)) & F.max(kind.isin(*KINDS)) & F.max(acts)).alias("asks"))


def operands(slots: DataFrame, most: int = 12) -> DataFrame:
    """``query_id, at, operand``: what is searched for one by one: the ways in which the first subject is written, then the words for what was done."""
    subject = slots.where(strip(F.coalesce("subject", F.lit(""))) != "").groupBy("query_id").agg(F.min_by("subject", "at").alias("subject"))
    names = subject.select("query_id", F.posexplode(F.split("subject", "[|｜/、,，]")).alias("at", "operand"))
    acts = slots.select("query_id", F.col("at").alias("slot"), F.posexplode("terms").alias("k", "operand")).select("query_id", (1000 + F.col("slot") * 1000 + F.col("k")).alias("at"), "operand")
    all_of = unique_values(names.unionByName(acts), "query_id", "operand", "at")
    return all_of.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("at") <= most)


def merged_members(members: DataFrame) -> DataFrame:
    """Members (``query_id, at, name, chunk_id, quote``) that a passage stands for, each name once, in its first spelling."""
    return unique_values(members.where(F.coalesce("chunk_id", F.lit("")) != ""), "query_id", "name", "at")


def member_record(members: DataFrame) -> DataFrame:
    """``query_id, record``: the members with their quotes, and their number."""
    quote = collapse(F.coalesce("quote", F.lit("")))
    line = F.concat(F.lit("- "), F.col("name"), F.when(quote != "", F.concat(F.lit(" — "), truncate(quote, 120))).otherwise(F.lit("")))
    rows = members.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))).alias("m"))
    return rows.select("query_id", F.concat(F.array_join("m.l", "\n"), F.lit("\nEnumerated members across all evidence: "), F.size("m").cast("string")).alias("record"))
