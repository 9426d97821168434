"""Problem 2: one consistent form for texts that look the same, and the fields that need it.

Method: confusables skeleton. A text is decomposed, every character is replaced by the prototype of its look-alike
class, and the result is decomposed again; two texts look the same if their skeletons are equal.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.session import table

# Letters of other scripts and the Latin letters they look like, as a reader of a text takes them; the
# rest of the look-alikes comes from look_alikes().
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ք": "f", "ʏ": "y", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
}
# Signs that are written in several ways.
SIGNS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "ʼ": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"', "″": '"',
         "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-", "․": ".", "。": ".", "∕": "/", "⁄": "/", "∶": ":", "ǃ": "!"}
#: Characters that show nothing; the joiner and the variation selectors are kept inside an emoji.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿ﾠ"
EMOJI = "←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
_drop = re.compile(f"(?<=[{EMOJI}️])[‍️](?=[{EMOJI}])|(?<=[{EMOJI}])️‍?|[{INVISIBLE}]")
#: Anything beyond ASCII and the accented letters that are one character each; texts without it are consistent as they are.
_special = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


def look_alikes() -> dict[str, str]:
    """Letters beyond Latin-1 and the one Latin letter that each looks like, by the Unicode confusables table that Spark's own ICU library carries.

    Of the table only letters with one ASCII letter as their prototype count, since the form is to be read by people: a
    capital that the table takes for a small l reads as I. Compatibility forms are left to normalisation.
    """
    import pyspark

    home = [os.path.join(os.path.dirname(pyspark.__file__), "jars"), os.path.join(os.environ.get("SPARK_HOME", ""), "jars")]
    jar = next((j for h in home for j in glob.glob(os.path.join(h, "icu4j-*.jar"))), None)
    if jar is None:
        raise RuntimeError("Spark's icu4j jar is needed for the table of look-alike letters")
    with zipfile.ZipFile(jar) as z:
        data = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    data = data[struct.unpack(">H", data[:2])[0] :]  # after the file's own header
    keys, n, values = struct.unpack(">iii", data[12:24])
    out = {}
    for key, value in zip(struct.unpack(f">{n}I", data[keys : keys + 4 * n]), struct.unpack(f">{n}H", data[values : values + 2 * n]), strict=True):
        char, like = chr(key & 0xFFFFFF), chr(value)
        if key >> 24 == 0 and char > "ÿ" and like.isascii() and like.isalpha() and unicodedata.category(char) in ("Lu", "Ll", "Lo", "Lt") and unicodedata.bidirectional(char) == "L" and unicodedata.normalize("NFKD", char) == char:
            out[char] = "I" if like == "l" and unicodedata.category(char) == "Lu" else like
    return out


LOOK_ALIKES = look_alikes() | LOOK_ALIKES
_prototype = {**LOOK_ALIKES, **SIGNS}
_beyond = re.compile("[^\x00-\x7f]")
_hidden = re.compile(f"[{INVISIBLE}\u200d\ufe0f]")  # without one of these _drop finds nothing


def _keep_emoji(m: re.Match) -> str:
    i, text = m.start(), m.string
    inside = i > 0 and re.match(f"[{EMOJI}️]", text[i - 1]) is not None and m.group()[0] in "‍️"
    return m.group() if inside else ""


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; null stays null. Words of other scripts take the same path, letter by letter."""
    if text is None or text.isascii() or not _special.search(text):
        return text
    text = unicodedata.normalize("NFKD", text)
    if _hidden.search(text):
        text = _drop.sub(_keep_emoji, text)
    text = _beyond.sub(lambda m: _prototype.get(m.group(), m.group()), text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text))


_other = "Ͱ-ϿЀ-ԯԱ-֏Ꭰ-᏿ꭰ-ꮿꓐ-꓿Ⲁ-⳿ⴰ-⵿ᐁ-ᙿ\U00010280-\U000103ff\U00010400-\U0001052f\U000118a0-\U000118ff\U00016f00-\U00016f9f"
_latin = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
_alike = re.escape("".join(k for k in LOOK_ALIKES if not "A" <= k <= "ɏ"))
_found = re.compile(
    "[！-～　]"  # full-width forms
    f"|[{_latin}][̀-ͯ]"  # an accent as a character of its own
    "|[   ]"  # spaces that do not break
    "|[­͏᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿]"  # invisible
    f"|(?<![{EMOJI}️])‍|‍(?![{EMOJI}])|‌"
    f"|[{_latin}][{_alike}]|[{_alike}][{_latin}]"  # scripts mixed in a word
)
_joiner_scripts = re.compile("[؀-ۿऀ-෿][‌‍]")
_word = re.compile(f"[{_other}{_latin}'’]+")
_wholly = re.compile(f"(?<![{_other}{_latin}])[{_alike}]+(?![{_other}{_latin}])")


def needs_form(text: str | None) -> bool:
    """Whether a field holds characters that a plain text of the same look would not hold (problem 2's cases)."""
    if text is None or text.isascii() or not _special.search(text):
        return False
    for m in _found.finditer(text):
        if m.group() in ("‌", "‍") and _joiner_scripts.match(text, max(0, m.start() - 1)):
            continue
        return True
    for m in _wholly.finditer(text):
        # A word made of look-alikes only: a disguise where the words beside it are Latin, unless a neighbour is of its own script.
        before, after = text[: m.start()][-40:], text[m.end() :][:40]
        near = _word.findall(before)[-1:] + _word.findall(after)[:1]
        if near and not any(re.search(f"[{_other}]", n) and not re.search(f"[{_latin}]", n) for n in near):
            return True
    return False


def consistent_forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field_name, original, form, changed, disguised: one row per row and field that is not null."""
    schema = f"{key} bigint, field_name string, original string, form string, changed boolean, disguised boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([(key, pa.int64()), ("field_name", pa.string()), ("original", pa.string()), ("form", pa.string()), ("changed", pa.bool_()), ("disguised", pa.bool_())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, name in enumerate(fields, 1):
                rows = [(i, x, consistent(x), needs_form(x)) for i, x in zip(ids, batch.column(k).to_pylist(), strict=True) if x is not None]
                if rows:
                    i, x, f, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([name] * len(i)), pa.array(x), pa.array(f), pa.array([a != b for a, b in zip(x, f, strict=True)]), pa.array(d)], schema=out_schema)

    return df.select(F.col(key).cast("bigint").alias(key), *fields).mapInArrow(run, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, field_name of the train fields that hold disguised characters. Null and blank fields have no row.

    A field whose consistent form equals it holds none, so the narrower check runs on changed fields.
    """
    forms = consistent_forms(table(spark, sf_dir, "train"), "row_id", ["body", "rule"])
    return forms.filter("changed and disguised").select("row_id", "field_name").distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, field_name, form: every field of train in its consistent form. Null fields have no row."""
    return consistent_forms(table(spark, sf_dir, "train"), "row_id", ["body", "rule"]).select("row_id", "field_name", "form")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form_hash, field_name, spellings, rows: forms that are written in more than one way, with the number of spellings and rows.

    Originals and skeletons are compared by 128 bits of hash each, so the shuffle carries no text, and counts are
    summed per partition first.
    """
    forms = consistent_forms(table(spark, sf_dir, "train"), "row_id", ["body", "rule"])
    h = lambda c: F.md5(F.encode(c, "UTF-8"))
    spelled = forms.groupBy("field_name", h(F.col("form")).alias("form_hash"), h(F.col("original")).alias("o")).agg(F.count("*").alias("n"))
    return spelled.groupBy("field_name", "form_hash").agg(F.count("*").alias("spellings"), F.sum("n").alias("rows")).filter("spellings > 1")
