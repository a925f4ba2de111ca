"""Keyword-stuffed and link-list pages: block-wise compression against what is usual, confirmed by sentence punctuation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, held, table

#: Characters of a block; blocks end at white space where there is some in their last third.
BLOCK = 1000
#: A block is redundant if its compression ratio is at most this share of the median ratio of blocks of its language
#: and length; about one block in twelve of pages of sentences is.
EXTREME = 0.85
#: Blocks that a language and length must have for a median of its own; with fewer, the nearest length that has them counts.
ENOUGH = 20
#: A page is redundant if its redundant blocks have at least this share of its bytes.
REDUNDANT = 0.4
#: Punctuation is sparse if sentences have at most this share of a page's characters: TESTDATA asks two thirds of stuffing.
SPARSE = 1 / 3
#: Characters and words of what counts as a sentence.
SHORTEST, LONGEST, WORDS = 8, 600, 4

#: Languages told apart, and the scripts of their letters.
LANGUAGES = {"en": "latin", "fr": "latin", "de": "latin", "es": "latin", "ru": "cyrillic", "ar": "arabic", "ja": "cjk"}
LETTERS = {"cyrillic": "[Ѐ-ӿ]", "arabic": "[؀-ۿ]", "cjk": "[぀-ヿ一-鿿]"}

#: Markup, words joined by signs (addresses, paths, compounds) and words with a sign before them are one symbol each
#: to the compressor, so that lists of them are as redundant as they look, whatever their names are.
_JOINED = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++[\])]?[./:@_=&?#-]++[\[(]?[\p{L}\p{N}]\S*+|<[^<>]*+>|[#＃$][\p{L}\p{N}]\S*+"
#: Marks that end a sentence with spaces between words, and without; signs that play no part between words.
_STOPS, _FULL_STOPS, _SIGNS = ".!?؟।", "。！？", ",;:\"()“”„«»"
#: Upper case and digits, to the compressor.
_ALIKE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of the value, which is computed once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def evened(text: Column) -> Column:
    """The text with runs of spaces as one."""
    return F.regexp_replace(text, "  +", " ")


def blocks_of(text: Column) -> Column:
    """The text in blocks of up to BLOCK characters; a short rest belongs to the last one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK * 4 // 3}}}\z|.{{{BLOCK * 2 // 3},{BLOCK}}}(?=\s)|.{{1,{BLOCK}}}"), F.lit(0))


def folded(block: Column) -> Column:
    """What is compressed of a block, but for letter case and digits: joined words as one symbol."""
    return F.regexp_replace(block, _JOINED, "\x01")


def punctuated(text: Column) -> Column:
    """Share of the text's characters in sentences.

    A sentence ends with its mark, is no longer than LONGEST, has WORDS words (its mark alone tells where words aren't
    spaced), and no pair of words occurs twice in it: keywords dressed as sentences repeat theirs.
    """

    def proper(s: Column) -> Column:
        words = F.split(F.btrim(s, F.lit(" " + _STOPS + _FULL_STOPS)), " ")
        pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))
        once = lambda w: _let(pairs(w), lambda p: F.size(F.array_distinct(p)) == F.size(p))
        spaced = lambda last: last.isin(*_STOPS) & _let(words, lambda w: (F.size(w) >= WORDS) & once(w))
        unspaced = lambda last: last.isin(*_FULL_STOPS) & _let(words, once)
        return F.length(s).between(SHORTEST, LONGEST) & _let(F.substring(s, -1, 1), lambda last: spaced(last) | unspaced(last))

    def share(plain: Column) -> Column:
        in_sentences = F.aggregate(F.filter(F.split(plain, "\n"), proper), F.lit(0), lambda n, s: n + F.length(s))
        return in_sentences / F.greatest(F.length(plain), F.lit(1))

    plain = F.lower(text)
    for sign in _SIGNS:
        plain = F.replace(plain, F.lit(sign), F.lit(""))
    for here, there in [("  ", " "), ("\r", "\n"), ("<", "\n<"), *[(f"{s} ", f"{s}\n") for s in _STOPS], *[(s, f"{s}\n") for s in _FULL_STOPS]]:
        plain = F.replace(plain, F.lit(here), F.lit(there))
    return _let(plain, share)


def language_class(text: Column, lang: Column) -> Column:
    """The language if the text's letters are of its script, else the script."""
    script = F.lit("latin")
    for name, letters in reversed(LETTERS.items()):
        script = F.when(F.regexp_count(text, F.lit(letters)) > 0.3 * F.length(text), name).otherwise(script)
    script = F.when(F.octet_length(text) <= 1.3 * F.length(text), F.lit("latin")).otherwise(script)  # a letter of the others has two bytes or three
    own = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.coalesce(lang, F.lit(""))]
    return F.when(own == script, lang).otherwise(script)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folds of the last column replaced by their compressed sizes in bytes."""
    for b in batches:
        folds, sizes = b.column(b.num_columns - 1), []
        for f in folds.flatten().cast(pa.binary()).to_pylist():
            c = zlib.compressobj(6, zlib.DEFLATED, -12, 4)
            sizes.append(len(c.compress(f.translate(_ALIKE))) + len(c.flush()))
        offsets = pa.array([0, *folds.value_lengths().to_pylist()], pa.int64()).to_numpy().cumsum()
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sizes, pa.int32()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "packed"])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, kind (language class), punctuated, and of each block bytes, size (length class), packed (bytes), of every row with a text.

    Everything but the compressing is done in the JVM; only folded blocks go to Python, by Arrow batches."""
    some = docs.where(F.col("text").rlike(r"(?U)\S")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    some = held(some.select("doc_id", "lang", "text"), "even", evened(F.col("text")))
    d = some.select(
        "doc_id",
        language_class(F.col("even"), F.col("lang")).alias("kind"),
        punctuated(F.col("even")).alias("punctuated"),
        blocks_of(F.col("even")).alias("blocks"),
    )
    d = d.select(
        "doc_id", "kind", "punctuated",
        F.transform("blocks", F.octet_length).alias("bytes"),
        F.transform("blocks", lambda b: F.round(2 * F.log2(F.length(b))).cast("int")).alias("size"),
        F.transform("blocks", folded).alias("folds"),
    )
    return d.mapInArrow(_packed, "doc_id long, kind string, punctuated double, bytes array<int>, size array<int>, packed array<int>")


def usual_ratios(measured: DataFrame) -> dict[tuple[str, int], float]:
    """Median compression ratio of the blocks of each language class and length class, over all pages.

    A class of fewer than ENOUGH blocks has the median of the nearest length of its language with so many, else of any
    language, else its own. There are 7 languages and 4 scripts at most and 22 length classes, whatever the input."""
    b = measured.select("kind", F.explode(F.arrays_zip("bytes", "size", "packed")).alias("b"))
    b = b.groupBy("kind", F.col("b.size").alias("size")).agg(F.percentile_approx(F.col("b.packed") / F.col("b.bytes"), 0.5, 10_000).alias("usual"), F.count("*").alias("n"))
    rows = b.collect()
    dense = [r for r in rows if r.n >= ENOUGH] or rows

    def norm(r) -> float:
        return r.usual if r.n >= ENOUGH else min(dense, key=lambda d: (d.kind != r.kind, abs(d.size - r.size), d.kind, d.size)).usual

    return {(r.kind, r.size): norm(r) for r in rows}


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """doc_id, redundant, punctuated of pages of repeated keywords, link lists or tags; repeats each for itself.

    A page is flagged if its redundant blocks (compression ratio at most EXTREME times the median of the language and
    length) have REDUNDANT of its bytes, and confirmed if its sentences (see punctuated) have at most SPARSE of its
    characters. Null, empty and blank texts are none; lang may be null or wrong. doc_id is a bigint. A language and
    length with few blocks is normalised by the nearest length (see usual_ratios), a table of so few pages by itself, and
    a language most of whose blocks are stuffed by stuffed ones.

    Plan: one pass over whole texts without a shuffle; its measures (a few numbers a block) are written once. The
    norms are at most a few hundred numbers.
    """
    m = cut_lineage(measures(docs))
    usual = usual_ratios(m)
    pairs = [F.lit(x) for (kind, size), v in sorted(usual.items()) for x in (f"{kind} {size}", v)]
    norm = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    m = m.withColumn("norm", norm)
    is_redundant = lambda b: b["packed"] <= EXTREME * F.col("norm")[F.concat_ws(" ", F.col("kind"), b["size"].cast("string"))] * b["bytes"]
    size = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + b["bytes"])
    blocks = F.arrays_zip("bytes", "size", "packed")
    got = m.select("doc_id", (size(F.filter(blocks, is_redundant)) / size(blocks)).alias("redundant"), "punctuated")
    return got.where((F.col("redundant") >= REDUNDANT) & (F.col("punctuated") <= SPARSE))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
