"""Texts that look alike but are stored in different characters, brought to one form.

A text is exploded to positioned code points (stretches of ASCII, which no mapping changes, travel as one piece), each is
joined to a broadcast mapping, and the text is rebuilt, its combining marks ordered by class and composed again. The
mapping is made by rule from the Unicode tables: canonical decomposition, width forms and blanks by their plain form,
invisible characters by nothing, and look-alike letters of other scripts by the Latin ones below. Compatibility forms that
a reader can tell apart (superscripts, circled digits and the like) stay.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.joins import salted_join
from quotemill.session import stored

# Letters of other scripts with the Latin ones that they cannot be told from.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "Ү": "Y", "Ѕ": "S", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮯ": "C",
    "Ꮲ": "P", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # signs
    "‐": "-", "‑": "-", "ꞌ": "'",
}
# Characters without a glyph of their own. Format characters of category Cf are among them by rule.
INVISIBLE = "­͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
PIECES = r"[\x00-\x7E]+(?=[\x00-\x7E])|(?s:.)"


def _plain(ch: str) -> str:
    """The canonical decomposition of a character after its width form, blank or look-alike is replaced."""
    kind = unicodedata.category(ch)
    if ch in INVISIBLE or kind == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    form = unicodedata.decomposition(ch)
    if form.startswith(("<wide>", "<narrow>")) or 0xFB00 <= ord(ch) <= 0xFB06:
        return "".join(_plain(x) for x in unicodedata.normalize("NFKC", ch))
    parts = unicodedata.normalize("NFD", ch)
    return "".join(LOOKALIKES.get(x, x) if len(parts) > 1 or x not in LOOKALIKES else LOOKALIKES[x] for x in parts)


@functools.cache
def mapping() -> tuple[tuple[str, str], ...]:
    """Every character whose plain form differs from itself. Fewer than 20,000 by the Unicode tables."""
    return tuple((chr(c), p) for c in range(0x7F, 0x110000) if not 0xD800 <= c <= 0xDFFF and (p := _plain(chr(c))) != chr(c))


def mapping_table(spark: SparkSession) -> DataFrame:
    piece, plain = zip(*mapping())
    return spark.createDataFrame(pa.table({"piece": pa.array(piece), "plain": pa.array(plain)}))


def one_form(text: str) -> str:
    """The form of one text; what the distributed operator must give."""
    text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFC", "".join(PLAIN.get(c, c) for c in text))


class _Plain(dict):
    def __missing__(self, key):
        self.update(mapping())
        return self.setdefault(key, key)

    def get(self, key, default=None):
        if not self:
            self.update(mapping())
        return super().get(key, default)


PLAIN = _Plain()


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Order the combining marks of each text by class and compose it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _key(text):
    return F.unhex(F.sha2(text, 256))


def _other() -> Column:
    """Whether a text holds more than ASCII, or a carriage return before a line end. Other texts are their own form."""
    return F.col("text").rlike(r"[^\x00-\x7E]|\r\n")


def distinct_forms(documents: DataFrame) -> DataFrame:
    """(key, form, copies) of each distinct text that may differ from its form; key is the text's SHA-256.

    Copies are reduced to one before anything else, and the texts, not their code points, are shuffled, once: the explode,
    the broadcast join and the rebuilding all happen where a text lies.
    """
    texts = documents.where(_other()).groupBy(_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = F.regexp_extract_all(F.regexp_replace("text", "\r\n", "\n"), F.lit(PIECES), F.lit(0))
    pieces = texts.select("key", "copies", F.posexplode(found).alias("pos", "piece"))
    mapped = pieces.join(F.broadcast(mapping_table(documents.sparkSession)), "piece", "left").select("key", "copies", "pos", F.coalesce("plain", "piece").alias("plain"))
    inorder = F.array_sort(F.collect_list(F.struct("pos", "plain")))
    rebuilt = mapped.groupBy("key", "copies").agg(F.array_join(F.transform(inorder, lambda x: x["plain"]), "").alias("form"))
    return rebuilt.select("key", _composed("form").alias("form"), "copies")


HOT_SHARE = 1000  # a text is hot if its copies are more than this part of all rows; there are fewer hot texts than that
SALTS = 64


def normalise_texts(documents: DataFrame) -> DataFrame:
    """Documents with their text in one form (column form), all other columns kept.

    Texts that look alike have equal forms; texts that a reader can tell apart keep different ones. Case, accents, digits,
    punctuation and the number of blanks count; CR LF counts as a line end. Pure ASCII stays as it is, and where it lies. A
    null text has a null form, an empty one an empty form; so has a text of invisible characters only. Repeated rows stay repeated.
    Forms of hot texts, fewer than HOT_SHARE, are repeated SALTS times for the join; all others come once.
    """
    forms = stored(distinct_forms(documents), "text-forms")
    total = forms.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > max(1, total / HOT_SHARE)
    hot = forms.where(is_hot).select(F.col("key").alias("_key"), F.lit(SALTS).alias("_salts"))
    last_salt = F.when(is_hot, SALTS - 1).otherwise(0)
    forms = forms.select(F.col("key").alias("_key"), F.col("form").alias("_form"), F.explode(F.sequence(F.lit(0), last_salt)).alias("_salt"))
    kept = [c for c in documents.columns if c != "form"]
    keyed = documents.where(_other()).select(*kept, _key(F.col("text")).alias("_key")).join(F.broadcast(hot), "_key", "left")
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int"))
    changed = keyed.join(forms, ["_key", "_salt"]).select(*kept, F.col("_form").alias("form"))
    same = documents.where(F.col("text").isNull() | ~_other()).select(*kept, F.col("text").alias("form"))
    return same.unionByName(changed)


def _members(documents: DataFrame) -> DataFrame:
    """(doc_id, key, class) of the documents whose form is that of another stored text, too."""
    forms = distinct_forms(documents).select("key", _key(F.col("form")).alias("class"))
    plain = documents.where(F.col("text").isNotNull()).where(~_other()).select(_key(F.col("text")).alias("key")).distinct().withColumn("class", F.col("key"))
    classes = stored(forms.unionByName(plain), "text-classes")
    shared = classes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    members = classes.join(shared, "class", "left_semi")
    ids = documents.where("doc_id is not null and text is not null").select("doc_id", _key(F.col("text")).alias("key"))
    return stored(salted_join(ids, members, ["key"], F.col("doc_id"), "inner").select("doc_id", "key", "class").distinct(), "lookalike-members")


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class, n_alike) of each document that looks like a differently stored one; n_alike counts those.

    class is the hexadecimal SHA-256 of the form. Copies are not expanded into pairs, so a class of any size costs its rows.
    """
    held = _members(documents)
    texts = held.groupBy("class", "key").agg(F.count("*").alias("same"))
    whole = texts.groupBy("class").agg(F.sum("same").alias("all"))
    counts = texts.join(whole, "class").select("class", "key", (F.col("all") - F.col("same")).alias("n_alike")).where("n_alike > 0")
    return salted_join(held, counts, ["class", "key"], F.col("doc_id"), "inner").select("doc_id", F.lower(F.hex("class")).alias("class"), "n_alike")


PAIR_ROWS = 1024


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: every pair of documents whose texts look alike but are stored differently.

    Compared are distinct texts by their form's SHA-256; only texts that share a form with another are joined back to their
    documents. Copies of one stored text are no pair. Null texts and null ids are in none. Documents of one id that differ in
    text are no pair either, as a pair needs two ids. A class of more than PAIR_ROWS documents is cut by document, and
    each part meets the whole class; lookalike_classes tells the same without pairs.
    """
    held = _members(documents)
    parts = F.ceil(F.col("n") / PAIR_ROWS).cast("int")
    sizes = held.groupBy("class").agg(F.count("*").alias("n")).withColumn("parts", parts)
    sized = salted_join(held, sizes.select("class", "parts"), ["class"], F.col("doc_id"), "inner")
    a = sized.select("class", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.col("doc_id").alias("doc_id_a"), F.col("key").alias("key_a"))
    b = sized.select("class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("doc_id").alias("doc_id_b"), F.col("key").alias("key_b"))
    pairs = a.join(b, ["class", "part"]).where((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("key_a") != F.col("key_b")))
    return pairs.select("doc_id_a", "doc_id_b").distinct()
