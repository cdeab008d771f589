"""Text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
#: A run of Han characters, or one of other letters and digits.
RUN = r"[\p{IsHan}]+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"


def terms(text: Column) -> Column:
    """Index terms: lower-cased runs of non-Han letters and digits of two bytes or more, and bigrams of Han runs."""

    def of_run(run: Column) -> Column:
        n = F.length(run)
        bigrams = F.when(n == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))
        word = F.when(F.octet_length(run) >= 2, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^{HAN}"), bigrams).otherwise(word)

    low = F.lower(F.coalesce(text, F.lit("")))
    # Most texts hold no Han character, as none stands before U+2E80, and their runs need no second look: two characters, or one of several bytes.
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{Nd}]{2,}|[\p{L}\p{Nd}&&[^\x00-\x7F]]"), F.lit(0))
    return F.when(low.rlike(r"[^\x{0}-\x{2E7F}]") & low.rlike(HAN), F.flatten(F.transform(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)), of_run))).otherwise(plain)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    return F.lower(collapse(text))


def truncate(text: Column, n: int, mark: str = "") -> Column:
    """At most ``n`` characters; a mark takes the place of the last ones."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - len(mark))), F.lit(mark)))


def first_sentence(text: Column, n: int) -> Column:
    """A text of at most ``n`` characters whole; else up to the first full stop or line feed among them, else ``n`` characters and an ellipsis."""
    head = F.left(text, F.lit(n))
    sentence = F.regexp_extract(head, r"^[^。.\n]*[。.\n]", 0)
    cut = F.when(sentence != "", strip(sentence)).otherwise(F.concat(strip(head), F.lit("…")))
    return F.when(F.length(text) <= n, strip(text)).otherwise(cut)


def display_name(name: Column) -> Column:
    """A file name without extension, without a leading token of six hex digits or more before others, underscores as blanks, at most sixty characters."""
    stem = F.regexp_replace(strip(name), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"^[0-9a-fA-F]{6,}(?=[_ -]+[^_ -])", "")
    return truncate(strip(F.replace(stem, F.lit("_"), F.lit(" "))), 60, "…")


def share_of(text: Column, inside: str) -> Column:
    """Share of the characters of a text that a character class holds."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, f"[^{inside}]", "")) / F.length(text)).otherwise(0.0)


def is_cjk(text: Column, threshold: float = 0.2) -> Column:
    """Whether a text counts as Chinese, Japanese or Korean: more than a share of its characters is."""
    return share_of(text, "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯") > threshold


def mostly_han(text: Column, threshold: float = 0.15) -> Column:
    """The narrower test: unified Han characters alone."""
    return share_of(text, "一-鿿") > threshold


def gist(text: Column, n: int) -> Column:
    """Of a longer text the first ``n`` characters up to the last sentence end in their last two fifths, else up to the last blank there, else
    all of them; a mark says that it was cut."""
    head = F.left(text, F.lit(n))
    least = max(1, n * 6 // 10)
    sentence = F.regexp_extract(head, r"(?s)^.*[.!?;。！？；]", 0)
    word = F.regexp_extract(head, r"(?s)^(.*)[ \t]", 1)
    cut = F.when(F.length(sentence) > least, sentence).when(F.length(word) >= least, word).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, r"[ \t]+$", ""), F.lit(" […]")))


def contains_fold(text: Column, part: Column) -> Column:
    return (F.trim(part) != "") & F.contains(F.lower(text), F.lower(F.trim(part)))


def quote_around(text: Column, part: Column, before: int = 80, after: int = 60) -> Column:
    """The text around the first occurrence of a part."""
    at = F.instr(F.lower(text), F.lower(part))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(part) + after))


def strip_think(text: Column) -> Column:
    """Without the marked reasoning, closed or left open."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def split_combined(value: Column) -> Column:
    """The different parts of a value that lists several."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"[、,，;；|]+"), F.trim), lambda x: x != ""))


def content_tokens(text: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 4) & ~t.isin(stop)))


def grams(tokens: Column, n: int = 5) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


#: Fixed: the characters that end a sentence.
ENDS = "。！？；.!?\n"


def sentences(text: Column) -> Column:
    """Stripped sentences; each of the characters that end one ends one."""
    parts = F.regexp_extract_all(text, F.lit(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_short(text: Column) -> Column:
    """Fewer than forty characters with a Han one among them, or fewer than twenty words; a blank text is."""
    body = strip(text)
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    return F.when(body.rlike("[㐀-䶿一-鿿豈-﫿]"), F.length(body) < 40).otherwise(words < 20)


def heading_title(text: Column, block_type: Column, most: int = 120) -> Column:
    """The heading of a heading chunk: of a section its first paragraph where that reads like one."""
    body = strip(text)
    head = strip(F.split(body, "\n\n", 2)[0])
    prose = (head == "") | (F.length(head) > most) | F.endswith(head, F.lit("。"))
    return F.when((block_type != "Section") | prose, truncate(body, most, "…")).otherwise(head)


def strip_numbers(text: Column) -> Column:
    """Without runs of digits, signs of number and units that hold no letter."""
    return collapse(F.regexp_replace(text, r"(?<![\p{L}\p{N}])[\p{N}][\p{N}.,:/%+-]*(?![\p{L}\p{N}])", " "))


def tool_error(tool: Column, reason: Column) -> Column:
    """What a failed call reads as: an element with the reason, at most four hundred characters of it."""
    return F.concat(F.lit('<tool_error tool="'), escape_markup(tool), F.lit('">'), escape_markup(truncate(reason, 400)), F.lit("</tool_error>"))


def rune_hash(text: Column) -> Column:
    """A 32-bit multiplicative hash over code points, by which templates take turns in a way that can be replayed."""
    step = lambda value, c: (value.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


#: Words that a search for the exact string is never made of.
UNGREPPABLE = """
the a an and or but if of to in on at for with by from as into over under about after before than then that this these those it its he
she they them his her their is are was were be been being has have had do does did will would can could should may might must not no yes
all any both each more most other some such only own same so too very just also there when where which who whom what how why whether while
information details detail content article articles document documents passage text answer question evidence mention mentioned
statement source sources report news example thing things something anything data fact facts claim claims
""".split()


def greppable(terms: Column) -> Column:
    """Of an array of terms, in order, those of three characters or more that are more than function words and names of nothing in particular."""
    return F.filter(F.transform(terms, strip), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(UNGREPPABLE))
