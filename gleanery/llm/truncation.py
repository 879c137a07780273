"""Problem 9: text cut off by field limits or on its way.

Method: a structural completeness check. A stack automaton follows brackets, quotes, escapes, code fences and elements
of markup through the whole text; the end is then read as a sentence, a closing line that is no sentence, or neither.
Hard evidence (unclosed data or code, a mark of loss, a broken character) stands alone. In running text, a structure
left open counts unless whole texts of the source leave them open too, a missing terminator only in sources whose texts
usually have one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.scratch import Scratch

# Phrases that end a text with dots on purpose, labels of closing lines, greetings before a name.
_CONTINUED = (
    "to be continued", "more to come", "and so on", "and so forth", "etc", "et cetera", "fortsetzung folgt", "mehr folgt",
    "und so weiter", "usw", "à suivre", "et ainsi de suite", "continuará", "y así sucesivamente",
)
_LABELS = ("tags", "total", "score", "keywords", "schlagwörter", "gesamt", "summe", "mots-clés", "étiquettes", "etiquetas")
#: Closing rules look at this many last characters at a time; the automaton reads the whole text.
_LAST = 4096
_PAIRS = {"}": "{", "]": "[", ")": "("}
#: Quotes by what may close them; elements that have no end.
_QUOTES = {"„": "“”\"", "“": "”", "«": "»", "»": "«", "‚": "‘’", "‹": "›"}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_SIGNS = re.compile(r'[{}\[\]()"\\„“”«»‹›]|```|</?[A-Za-z][^<>]*>?')
_DATA = re.compile(r'\s*(?:\{\s*["}]|\[\s*[\[{"\]])')
_MARK = re.compile(r"(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…|[\[(](?:truncated|cut|snip)[\])])$", re.I)
_SENTENCE = re.compile(r"[.!?。！？]+[\"'’”»«)\]*_]*$")
_ASIDE = re.compile(r"\s(?:\([^()\[\]]{1,24}\)|\[[^()\[\]]{1,24}\]|[»«“\"][^»«”\"]{1,24}[«»”\"])$")
_RULE = re.compile(r"\s[*_~=•·–—-]{2,}$")
_TAGS = re.compile(r"(?:(?:^|\s)#\w+)+$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
_FILE = re.compile(r"^\S+\.[A-Za-z][A-Za-z0-9]{1,4}$")
_STEM = re.compile(r"(?:^|\s)[A-Za-z]{2,8}_\d{3,}\.$")
_NAME = re.compile(r"^(?:[—–-]\s*)?(?:[^\W\d_][\w'’.-]*)(?:\s[^\W\d_][\w'’.-]*){0,2}$")
_GREETING = re.compile(r"^[^\W\d_]+(?:\s[^\W\d_]+){0,3},?$")


class _Stack:
    """A stack that knows how many of each sign it holds, so a text is read in linear time."""

    def __init__(self) -> None:
        self.signs: list[str] = []
        self.held: dict[str, int] = {}

    def push(self, sign: str) -> None:
        self.signs.append(sign)
        self.held[sign] = self.held.get(sign, 0) + 1

    def close(self, sign: str) -> None:
        """Takes the last ``sign`` and what was left open within it; nothing where there is none."""
        if self.held.get(sign):
            while (top := self.signs.pop()) != sign:
                self.held[top] -= 1
            self.held[sign] -= 1

    @property
    def top(self) -> str:
        return self.signs[-1] if self.signs else ""


def open_structures(text: str) -> list[str]:
    """What is still open at the end: the automaton's stack, lowest first. Inside a fence only its end counts, inside a
    string of data (a text that begins as JSON does) only escapes and the closing quote. In running text a straight
    quote opens before a letter and after a blank or bracket, and closes behind anything but a blank (so feet and inches
    are none); elements of markup are <name>."""
    stack = _Stack()
    skip, data = -1, text.lstrip()[:1] in ("{", "[") and _DATA.match(text) is not None
    for m in _SIGNS.finditer(text):
        sign, top = m.group(), stack.top
        if m.start() < skip:
            continue
        if top == "```":
            if sign == "```":
                stack.close(sign)
        elif top == '"' and data:
            if sign == "\\":
                skip = m.end() + 1
                if m.end() >= len(text):
                    stack.push("\\")
            elif sign == '"':
                stack.close(sign)
        elif sign == "```":
            stack.push(sign)
        elif sign == '"':
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if data:
                stack.push(sign)
            elif (stack.held.get(sign) or stack.held.get("„")) and before.strip():
                stack.close(sign if stack.held.get(sign) else "„")
            elif (not before or not before.strip() or before in "([{—–-/") and (after.isalnum() or after == "" and m.start() > 0):
                stack.push(sign)
        elif sign in "{[(":
            stack.push(sign)
        elif sign in _PAIRS:
            stack.close(_PAIRS[sign])
        elif sign[0] == "<":
            name = re.match(r"</?([A-Za-z][\w-]*)", sign).group(1).lower()
            if not sign.endswith(">"):
                if m.end() >= len(text.rstrip()):
                    stack.push("<")
            elif sign[1] == "/":
                stack.close(f"<{name}>")
            elif not sign.endswith("/>") and name not in _VOID:
                stack.push(f"<{name}>")
        elif opener := next((o for o in stack.signs[:-9:-1] if sign in _QUOTES.get(o, "")), None):
            stack.close(opener)
        elif sign in _QUOTES:
            stack.push(sign)
    return stack.signs


def judge_end(text: str) -> tuple[str, bool]:
    """(end, open). end: 'whole', 'soft' (no sign of an end), or the hard evidence: 'open', 'mark', 'broken', 'word'.
    open: whether the automaton ended with anything on its stack."""
    end = text.rstrip().rstrip("\u200b\ufeff")
    if not end:
        return "whole", False
    stack = open_structures(end)
    if end[-1] == "\ufffd" or "\ud800" <= end[-1] <= "\udfff":
        return "broken", bool(stack)
    if end.lstrip()[:1] in ("{", "[") and _DATA.match(end):
        return "open" if stack else "whole", bool(stack)
    if "```" in stack or "<" in stack:
        return "open", True
    last = end[-_LAST:]
    mark = _MARK.search(last)
    if mark:
        return "whole" if last[: mark.start()].rstrip(" .").lower().endswith(_CONTINUED) else "mark", bool(stack)
    if _STEM.search(last):
        return "word", bool(stack)
    return "whole" if _complete(end) or _closing_line(end) else "soft", bool(stack)


def _bare(end: str) -> str:
    """Without what may follow a sentence: pictures, tags, a rule of signs, a short aside in brackets or quotes."""
    while True:
        before = end
        end = end.rstrip()
        while end and (unicodedata.category(end[-1]) in ("So", "Sk", "Cf", "Mn") or end[-1] in "\u200d\ufe0f"):
            end = end[:-1].rstrip()
        for rule in (_TAGS, _ASIDE, _RULE):
            last = end[-_LAST:]  # what a rule can take is short; longer runs go in several rounds
            m = rule.search(last)
            if m and (m.start() > 0 or len(last) < len(end)):
                end = end[: len(end) - len(last) + m.start()]
        if end == before:
            return end


def _complete(end: str) -> bool:
    return bool(_SENTENCE.search(end.rstrip()[-_LAST:]) or _SENTENCE.search(_bare(end)[-_LAST:]))


def _closing_line(end: str) -> bool:
    """Names, tags, lists, file names, totals, code: proper ends without a terminator."""
    if end.endswith("```") or re.search(r"</[A-Za-z][\w-]*>$|/>$", end):
        return True
    head, _, last = end.rpartition("\n")
    last, lines = last.strip(), [x.strip() for x in head.split("\n") if x.strip()]
    before = lines[-1] if lines else ""
    if _TAGS.fullmatch(last):
        return True
    if _ITEM.match(last) and not last.endswith((",", "-", ":")) and (
        not before or _complete(before) or _ITEM.match(before) or before.endswith(":") or _closing_line(head.rstrip())
    ):
        return True
    label, colon, value = last.partition(":")
    if colon and label.strip().lower() in _LABELS and value.strip() and not value.rstrip().endswith((",", "-")):
        return True
    if not before:
        return False
    settled = _complete(before)
    if _FILE.match(last):
        return settled
    if last[:1] in "—–" and _NAME.match(last):
        return settled
    return bool(_NAME.match(last) and len(lines) > 1 and len(before) <= 40 and _GREETING.match(before) and _complete(lines[-2]))


def source_name(source: Column) -> Column:
    """One writing per source: trimmed, lower case, ``_`` for ``-`` and blanks; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[-\s\u00a0]+", "_")


def decoded(raw: bytes) -> tuple[str, bool]:
    """(text, broken): bytes as text, whatever they hold; broken tells that they end inside a multibyte sequence."""
    try:
        return raw.decode("utf-8"), False
    except UnicodeDecodeError:
        back = 1
        while back < min(4, len(raw)) and 0x80 <= raw[-back] < 0xC0:
            back += 1
        lead = raw[-back]
        return raw.decode("utf-8", "replace"), lead >= 0xC0 and back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends, left = [], []
        for raw in b.column("text").to_pylist():
            text, broken = decoded(raw)
            end, open_ = judge_end(text)
            ends.append("broken" if broken else end)
            left.append(open_)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("source"), pa.array(ends, pa.string()), pa.array(left, pa.bool_())], ["id", "source", "end", "open"]
        )


def truncated(
    df: DataFrame, id_col: str, text_col: str, source_col: str, usual: float = 0.5, rare: float = 0.1
) -> DataFrame:
    """(id, source, end, cut) for every record with a text that is not blank; cut tells whether it was truncated, end by
    what evidence.

    A text without any sign of an end ('soft') is cut unless the texts of its source lack one in a share of ``usual``
    or more. If the automaton leaves a structure open in it, its end is 'open', and it is cut unless it leaves one open
    in a share of ``rare`` or more of the source's whole texts.

    Null, empty and blank texts are left out; bytes that are no UTF-8 are read as far as they are, and a text that ends
    inside a multibyte sequence is cut; sources in several writings are one, a null source is one too; repeated rows
    count once; whole texts are read however long, in linear time; an empty table gives an empty result; extra columns
    are ignored. Only counts per source are shuffled.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), source_name(F.col(source_col)).alias("source")
    ).where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\u00a0\u200b\ufeff]"))
    kind = dict(rows.dtypes)["id"]
    rows = rows.withColumn("text", F.col("text").cast("binary"))  # strings may hold bytes that Python refuses
    ends = scratch.keep(rows.mapInArrow(_ends, f"id {kind}, source string, end string, open boolean"))
    end, soft = F.col("end"), F.col("end") == "soft"
    base = ends.groupBy("source").agg(
        (F.avg(soft.cast("double")) < usual).alias("ends_usual"),
        (F.coalesce(F.avg(F.when(end == "whole", F.col("open").cast("double"))), F.lit(0.0)) < rare).alias("open_rare"),
    )  # one row a source
    joined = ends.join(base.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    left_open = soft & F.col("open") & F.col("open_rare")
    cut = ~end.isin("whole", "soft") | left_open | (soft & F.col("ends_usual"))
    return joined.select("id", "source", F.when(left_open, "open").otherwise(end).alias("end"), cut.alias("cut")).distinct()


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return truncated(docs, "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents whose stored text ends inside a word or sentence because the rest was lost."""
    return _run(spark, sf_dir).where("cut").select(F.col("id").alias("doc_id")).distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates, and by what evidence."""
    count = lambda end: F.count_if(F.col("cut") & (F.col("end") == end))
    return _run(spark, sf_dir).groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("truncated"),
        F.round(F.count_if("cut") / F.count(F.lit(1)), 6).alias("share"), count("open").alias("open"),
        count("mark").alias("marked"), count("broken").alias("broken"), count("word").alias("in_word"),
        count("soft").alias("no_end"),
    )
