"""One form for text that looks the same: skeletons over a table of look-alike characters.

The table is the public one of Unicode (6,355 characters in its 2024 state), read from the ICU library among
Spark's jars when it is first used; the path is a parameter. The driver reads it and the tasks get the table, of
some hundred KB, with the function, so executors need no file. A supplement of Han forms, kana and a few
letters that the public table keeps apart is written out below.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zipfile
from collections.abc import Callable, Iterable
from functools import cache
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosopa.session import cut, slice_join

#: Where the public table is; None means the ICU library among Spark's jars.
CONFUSABLES_JAR: str | None = None
# Look-alike forms beyond the public table, each group followed by the form all of them become.
SUPPLEMENT = {
    "Ԛ": "Q", "к κ ĸ": "k", "ӏ": "l", "т τ ᴛ": "t", "‹ ˂": "〈", "› ˃": "〉",
    "チ": "千", "オ": "才", "ヒ": "匕", "ム ㄙ": "厶", "メ ㄨ": "乂", "ヨ ㄐ": "彐", "ミ": "彡", "ㄚ": "丫", "ㄇ": "冂", "ㄈ": "匚", "ㄠ": "幺", "ㄧ": "ー",
    "户": "戶", "内": "內", "為": "爲", "真": "眞", "清": "淸", "青": "靑", "説": "說", "教": "敎", "黄": "黃", "録": "錄", "衛": "衞", "顔": "顏", "緒": "緖", "呉": "吳",
    "兑": "兌", "税": "稅", "脱": "脫", "悦": "悅", "鋭": "銳", "温": "溫", "⺩": "王", "〜": "~", "︰": ":", "„": '"',
}
# Characters without ink that Unicode doesn't class as format or control characters.
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0x2800, 0x2800), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]


def _jar() -> str:
    """The ICU library of this Spark installation."""
    folders = [Path(CONFUSABLES_JAR).parent] if CONFUSABLES_JAR else [Path(f, "jars") for f in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)) if f]
    named = Path(CONFUSABLES_JAR).name if CONFUSABLES_JAR else "icu4j-*.jar"
    for folder in folders:
        for file in sorted(folder.glob(named)):
            return str(file)
    raise FileNotFoundError(f"no {named} in {', '.join(map(str, folders))}: set CONFUSABLES_JAR")


def public_table() -> dict[int, str]:
    """Unicode's prototypes by code point, from the compiled form of its confusables file: keys with the
    code point in 24 bits and the length of the prototype, less one, in the other 8; for each key a number that is the
    prototype itself, if that is one unit long, or its place in a table of 16-bit units."""
    with zipfile.ZipFile(_jar()) as jar:
        data = jar.read(next(n for n in jar.namelist() if n.endswith("confusables.cfu")))
    data = data[struct.unpack_from(">H", data)[0] :]
    keys_at, keys, index_at, _, text_at, units = struct.unpack_from(">6i", data, 12)
    key = struct.unpack_from(f">{keys}I", data, keys_at)
    index = struct.unpack_from(f">{keys}H", data, index_at)
    text = data[text_at : text_at + 2 * units]
    size = [(k >> 24) + 1 for k in key]
    return {k & 0xFFFFFF: chr(i) if n == 1 else text[2 * i : 2 * (i + n)].decode("utf-16-be") for k, i, n in zip(key, index, size, strict=True)}


@cache
def prototypes() -> dict[int, str]:
    """The look-alike table by code point; characters without ink, spaces of any kind included, become nothing."""
    table = public_table()
    extra = {ord(c): table.get(ord(form), form) for group, form in SUPPLEMENT.items() for c in group if c != " "}
    table = {c: form.translate(extra) for c, form in table.items()} | extra
    for low, high in INVISIBLE:
        table.update((c, "") for c in range(low, high + 1))
    for c in range(0x3100):
        if unicodedata.category(chr(c)) in ("Cc", "Cf", "Zs", "Zl", "Zp"):
            table[c] = ""
    table[0xFEFF] = ""
    return table


def skeleton_of(text: str, table: dict[int, str] | None = None) -> str:
    """Decompose, replace every character by its prototype, decompose again: once canonically, as the
    public table is meant, and once by compatibility, for wide, circled and other forms of one character."""
    table = prototypes() if table is None else table
    for form in ("NFD", "NFKD"):
        text = unicodedata.normalize("NFKD", unicodedata.normalize(form, text).translate(table))
    return text


@cache
def label_prototypes() -> dict[int, str]:
    """The table for labels, in which plain letters and digits stand for themselves, so that a letter
    remains one letter and slips can be counted. Signs are dropped from labels anyhow and need no entry."""
    return {c: form.replace("rn", "m") for c, form in prototypes().items() if (c > 127 and form) or chr(c).isalnum() and not form}


def label_key_of(text: str, table: dict[int, str] | None = None) -> str:
    """A label without case, spacing, punctuation, marks, look-alike and invisible characters."""
    table = label_prototypes() if table is None else table
    plain = unicodedata.normalize("NFKD", text)
    for _ in range(2):
        plain = plain.translate(table).casefold()
    return "".join(c for c in plain if c.isalnum())


@cache
def _mapped(of: Callable[[str, dict[int, str]], str], table_of: Callable[[], dict[int, str]]):
    """`of` as a function of columns that carries its table. Nulls stay null."""
    table = table_of()

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: of(text, table), na_action="ignore")

    return F.pandas_udf(each, T.StringType())


def skeleton(text: Column | str) -> Column:
    """The skeleton of each text; null stays null, text without ink becomes the empty text."""
    return _mapped(skeleton_of, prototypes)(text)


def label_key(text: Column | str) -> Column:
    """`label_key_of` of each text; null stays null."""
    return _mapped(label_key_of, label_prototypes)(text)


def skeleton_sql(name: str = "look", code_points: Iterable[int] = (*range(1, 0x2FA20), *range(0xE0000, 0xE1000))) -> str:
    """The table as SQL, `name(c, s)` with the skeleton of each character that isn't its own. Hangul
    syllables, which decompose by rule, are left out."""
    pairs = ((chr(c), skeleton_of(chr(c))) for c in code_points if not (0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF))
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return f"{name}(c, s) AS (VALUES " + ", ".join(f"({quoted(c)}, {quoted(s)})" for c, s in pairs if c != s) + ")"


def skeletons(df: DataFrame, col: str) -> DataFrame:
    """(value, skeleton, rows): each distinct non-null value of a column once, so that a value that
    fills a third of the rows is decomposed once and not shuffled row by row."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("value", skeleton("value").alias("skeleton"), "rows")


def skeleton_classes(df: DataFrame, col: str) -> DataFrame:
    """(value, class_value, members, rows): distinct values, the smallest value that looks the same,
    how many values look so, and how many rows hold the value. Values are compared by skeleton."""
    each = skeletons(df, col)
    whole = each.groupBy("skeleton").agg(F.min("value").alias("class_value"), F.count(F.lit(1)).alias("members"))
    return each.join(whole, "skeleton").select("value", "class_value", "members", "rows")


def disguised(values: DataFrame, col: str, references: DataFrame, ref_col: str) -> DataFrame:
    """(value, reference): the distinct values that equal no reference character by character but
    look the same as one (the smallest, if several). Nulls and texts without ink match nothing."""
    refs = references.where(F.col(ref_col).isNotNull()).select(F.col(ref_col).alias("reference")).distinct()
    odd = values.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().join(
        refs, F.col("value") == F.col("reference"), "left_anti"
    )
    look = refs.withColumn("skeleton", skeleton("reference")).where(F.col("skeleton") != "").groupBy("skeleton").agg(F.min("reference").alias("reference"))
    return odd.withColumn("skeleton", skeleton("value")).join(look, "skeleton").select("value", "reference")


def disguised_by_key(values: DataFrame, keys: list[str], col: str, references: DataFrame, ref_key: str, ref_col: str) -> DataFrame:
    """(*keys, reference): rows whose value, compared only with the references of the same `ref_key`,
    equals none character by character but looks the same as one (the smallest, if several). `values` has
    `keys`, `ref_key` and `col`; it is computed once. Nulls and texts without ink match nothing.

    Skeletons are taken of distinct (key, value) pairs, of references only where their key is asked for, and pairs
    meet by key and skeleton. Rows find their pair again in slices, so one hot key is no single task.
    """
    rows = cut(values.where(F.col(ref_key).isNotNull() & F.col(col).isNotNull()).select(*keys, F.col(ref_key).alias("_of"), F.col(col).alias("_value")))
    asked = rows.select("_of", "_value").distinct()
    refs = references.where(F.col(ref_key).isNotNull() & F.col(ref_col).isNotNull()).select(F.col(ref_key).alias("_of"), F.col(ref_col).alias("reference")).distinct()
    refs = refs.join(rows.select("_of"), "_of", "left_semi").withColumn("_skeleton", skeleton("reference")).where(F.col("_skeleton") != "")
    met = asked.withColumn("_skeleton", skeleton("_value")).join(refs, ["_of", "_skeleton"])
    found = met.groupBy("_of", "_value").agg(F.bool_or(F.col("_value") == F.col("reference")).alias("_same"), F.min("reference").alias("reference"))
    return slice_join(rows, found.where(~F.col("_same")).drop("_same"), ["_of", "_value"], keys, 65536).select(*keys, "reference").distinct()


def with_one_form(df: DataFrame, col: str, references: DataFrame, ref_col: str, out: str) -> DataFrame:
    """`df` with `out`: the reference a value equals or looks like, else the value itself. Any column
    names are fine in `df`, but a column named `out` is replaced."""
    found = disguised(df, col, references, ref_col).alias("_found_form")
    given = df.alias("_given_row")
    value = F.col(f"_given_row.`{col}`")
    kept = (F.col(f"_given_row.`{c}`").alias(c) for c in df.columns if c != out)
    return given.join(found, value == F.col("_found_form.value"), "left").select(*kept, F.coalesce(F.col("_found_form.reference"), value).alias(out))


__all__ = [
    "disguised", "disguised_by_key", "label_key", "label_key_of", "prototypes", "public_table", "skeleton", "skeleton_classes",
    "skeleton_of", "skeleton_sql", "skeletons", "with_one_form",
]
