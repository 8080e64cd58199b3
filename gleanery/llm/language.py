"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.arrays import in_slices
from gleanery.llm.scratch import discard, materialise, release_memory

#: Most bytes of a language's dictionary: the words that most of its texts hold.
DICTIONARY_BYTES = 48_000
#: Letters without a mark or blank between them that are longer, as in scripts without blanks, count as their
#: pieces of PIECE letters.
LONG_WORD, PIECE = 24, 4
#: Words of a language that a task counts before it hands them on.
COUNTED = 100_000
#: Texts are compressed in blocks of so many bytes, so that a long text leans on the dictionary
#: in each and not on itself.
BLOCK_BYTES = 4096
#: A margin of less than this share of the smallest size is narrow, where training has not told which are.
NARROW = 0.01
#: One in HELD training texts is judged by dictionaries that do not know it; the margin that is narrow then
#: loses at most LOST of the right decisions that are no ties. Margins are told apart by STEP.
HELD, LOST, STEP = 8, 0.002, 1e-4
UNDECIDED = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(text: str | None) -> str:
    """The words of a text in lower case, parted by single spaces; marks and digits say little
    of a language."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def word_set(text: str | None) -> set[str]:
    """What a text teaches: its distinct words, and pieces of long ones."""
    words = set(letters(text).split())
    for long in [w for w in words if len(w) > LONG_WORD]:
        words.discard(long)
        words.update(long[k : k + PIECE] for k in range(len(long) - PIECE + 1))
    return words


def train_dictionaries(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language from (text, lang) rows; null or letterless texts and
    null languages teach nothing. All other texts are read whole: a dictionary has the words that most
    texts of its language hold, the commonest last, where they are nearest to what is compressed. It does
    not depend on the order of rows. Languages come in the order of their rows' number."""
    rows = _teaching(labelled, text_column, lang_column)
    common, counts = _common(rows), _word_counts(rows)
    out = _dictionaries(counts.select("lang", "word", "n"), common)
    discard(counts)
    return out


def train_with_margin(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[dict[str, bytes], float]:
    """The dictionaries of train_dictionaries, and the margin under which their decisions are rejected:
    narrow_margin of the held texts, judged by the dictionaries of all others."""
    rows = _teaching(labelled, text_column, lang_column)
    common, counts = _common(rows), _word_counts(rows)
    dictionaries = _dictionaries(counts.select("lang", "word", "n"), common)
    others = _dictionaries(counts.select("lang", "word", (F.col("n") - F.col("held")).alias("n")).where("n > 0"), common)
    discard(counts)
    return dictionaries, narrow_margin(rows.where("held"), others)


def narrow_margin(held: DataFrame, dictionaries: dict[str, bytes]) -> float:
    """The largest margin (a multiple of STEP) under which at most LOST of the right decisions on held rows
    (lang, text) are that are no ties; NARROW where there are too few to tell."""
    shared = held.sparkSession.sparkContext.broadcast(dictionaries)

    def judge(batches: Iterator[pa.RecordBatch]):
        classifier = CompressionClassifier(shared.value)
        for batch in batches:
            made = [classifier.decide(t) for t in batch.column("text").to_pylist()]
            right = [int(m[1] / STEP) for lang, m in zip(batch.column("lang").to_pylist(), made) if m[0] == lang and m[1] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.int64())], names=["step"])
        release_memory()

    steps = held.select("lang", "text").mapInArrow(judge, "step long").groupBy("step").agg(F.count("*").alias("n"))
    per = sorted((r["step"], r["n"]) for r in steps.withColumn("step", F.least("step", F.lit(round(1 / STEP)))).groupBy("step").agg(F.sum("n").alias("n")).collect())
    most, lost = LOST * sum(n for _, n in per), 0
    if most < 1:
        return NARROW
    for step, n in per:
        lost += n
        if lost > most:
            return step * STEP
    return NARROW


def _teaching(labelled: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(lang, text, held) of the rows that teach; equal texts are held together."""
    rows = labelled.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0)


def _common(rows: DataFrame) -> list[str]:
    return [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()]


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n, held): how many texts of a language hold a word, and how many of these are held."""

    def count(batches: Iterator[pa.RecordBatch]):
        counts: dict[str, Counter] = defaultdict(Counter)
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text, out in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "held"))):
                words = word_set(text)
                counts[lang].update(words)
                if out:
                    held[lang].update(words)
                if len(counts[lang]) > COUNTED:
                    yield counted(lang, counts.pop(lang), held.pop(lang, {}))
        for lang in counts:
            yield counted(lang, counts[lang], held.get(lang, {}))
        release_memory()

    def counted(lang: str, counts: Counter, held: dict[str, int]) -> pa.RecordBatch:
        numbers = [list(counts.values()), [held.get(w, 0) for w in counts]]
        columns = [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), *(pa.array(n, pa.int64()) for n in numbers)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n", "held"])

    found = rows.mapInArrow(in_slices(count), "lang string, word string, n long, held long")
    return materialise(found.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("held").alias("held")))


def _dictionaries(counts: DataFrame, common: list[str]) -> dict[str, bytes]:
    """The dictionaries of counted words (lang, word, n), the languages in the order of `common`."""
    size = F.octet_length("word") + 1
    steps = counts.groupBy("lang", "n").agg(F.sum(size).alias("bytes"))
    steps = steps.withColumn("before", F.sum("bytes").over(Window.partitionBy("lang").orderBy(F.desc("n"))) - F.col("bytes"))
    least = steps.where(F.col("before") < DICTIONARY_BYTES).groupBy("lang").agg(F.min("n").alias("least"))
    words = counts.join(F.broadcast(least), "lang").where("n >= least").drop("least")
    for key in (["lang", F.pmod(F.xxhash64("word"), F.lit(64))], ["lang"]):  # parts of a language first, then the language
        by = Window.partitionBy(*key).orderBy(F.desc("n"), "word")
        words = words.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= DICTIONARY_BYTES // 2).withColumn("bytes", F.sum(size).over(by))
        words = words.where(F.col("bytes") <= DICTIONARY_BYTES)
    out: dict[str, list[str]] = {lang: [] for lang in common}
    for row in words.select("lang", "word", "bytes").orderBy("lang", F.desc("bytes")).collect():
        out[row["lang"]].append(row["word"])
    return {lang: " ".join([*found, ""]).encode() for lang, found in out.items()}


class CompressionClassifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], narrow: float = NARROW):
        import zstandard

        self.languages, self.narrow = list(dictionaries), narrow
        params = zstandard.ZstdCompressionParameters.from_level(
            1, strategy=zstandard.STRATEGY_BTOPT, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.compressors = []
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[k : k + BLOCK_BYTES] for k in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language, and by what share of its size the second smallest is larger; (UNDECIDED, 0) without a
        letter. Ties go to the language with more training rows."""
        words = letters(text)
        if not words or not self.languages:
            return UNDECIDED, 0.0
        sizes = self.sizes(words.encode())
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        return self.languages[order[0]], (sizes[order[1]] - best) / best if len(sizes) > 1 else 1.0

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the decision is rejected: no letter, a tie, or a
        margin of less than `narrow`. The score is 1/2 for equal sizes and nears 1 as the margin grows."""
        lang, margin = self.decide(text)
        if lang == UNDECIDED:
            return UNDECIDED, 0.0, True
        return lang, float(1 / (1 + np.exp(-40 * margin))), len(self.languages) > 1 and (margin <= 0 or margin < self.narrow)


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], text_column: str = "text", narrow: float = NARROW) -> DataFrame:
    """The rows with lang_pred, score and rejected (columns of these names are replaced). Decisions of
    a margin under `narrow` are rejected. Null, empty and letterless texts are `und`, score 0, rejected; so
    is every text if there are no dictionaries. Texts are judged whole, in one pass without a shuffle; the dictionaries
    (DICTIONARY_BYTES a language) are broadcast."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in kept.schema]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(dictionaries)

    def judge(batches: Iterator[pa.RecordBatch]):
        classifier = CompressionClassifier(shared.value, narrow)
        for batch in batches:
            made = [classifier.judge(t) for t in batch.column(text_column).to_pylist()]
            cols = [batch.column(f.name) for f in arrow if f.name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())],
                schema=arrow,
            )
        release_memory()

    return kept.mapInArrow(judge, schema)


def fold(modulus: int) -> Column:
    """The fold of a row: crc32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(4) == 2
    dictionaries, narrow = train_with_margin(docs.where(~held_out | held_out.isNull()))
    judged = identify_languages(docs.select("doc_id", "text"), dictionaries, narrow=narrow)
    return judged.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
