"""Language identification by compression (Benedetto, Caglioti and Loreto, 2002; Teahan, 2000).

Each language has a zstandard raw-content dictionary: the whole texts of a bounded sample of its rows. A text, in lower
case and with everything between letters turned into one space, is encoded with each dictionary in blocks, every block
behind the same short carrier of the dictionary, whose own size is taken off: alone, a short block would be stored raw
and tell nothing. The language whose dictionary makes the text smallest wins. The score is the share by which the best
beats the next; texts whose score is too small are rejected.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import runs, tidy, utf8

#: Labelled rows a language that are learned from.
PER_LANG = 64
#: Parts of a language's rows that are cut to the least hashes apart from each other.
PARTS = 64
#: Block and carrier in bytes, level of encoding; languages whose compressors a worker holds at once.
BLOCK, CARRIER, LEVEL, HELD = 4096, 200, 12, 64
#: Texts whose best dictionary saves less than this share over the next are rejected.
MARGIN = 0.005


def held_out(modulus: int = 4, rest: int = 2):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest


def learn(labelled: DataFrame, per_lang: int = PER_LANG) -> dict[str, bytes]:
    """{language: dictionary} from labelled (doc_id, text, lang): whole texts of the per_lang rows with the least hashes of doc_id and text.

    Every non-null lang with a text that has a letter is learned. Equal texts count once, and not at all under two languages. What reaches the
    driver and the workers is per_lang texts a language.
    """
    seen = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text").alias("t"))
    first = seen.groupBy("t").agg(F.min("lang").alias("lang"), F.max("lang").alias("other"), F.min("h").alias("h")).where("lang = other")
    least = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= per_lang)
    part = first.withColumn("part", F.pmod("h", F.lit(PARTS)))  # of a frequent language, few rows of each part meet
    top = least(least(part, "lang", "part"), "lang").select("lang", "h", "r")
    rows = labelled.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(top), ["lang", "h"])
    texts: dict[str, dict[int, bytes]] = {}
    for x in rows.select("lang", "r", "text").collect():
        texts.setdefault(x.lang, {})[x.r] = x.text.encode()
    return {k: b"\n".join(_letters(v[r]) for r in sorted(v)) for k, v in sorted(texts.items())}


def _letters(raw: bytes) -> bytes:
    return re.sub(r"[\W\d_]+", " ", raw.decode("utf-8", "replace").lower()).encode()


class _Packers:
    """(compress, carrier, size of the carrier alone) of each language; the HELD last used ones stay."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, carrier: int):
        self.get = lru_cache(HELD)(lambda lang: self._make(dictionaries[lang], level, carrier))

    @staticmethod
    def _make(data: bytes, level: int, carrier: int):
        import zstandard

        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        compress = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        start = data[:carrier] + b" "
        return compress, start, len(compress(start)) - 4


def predict(dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL, carrier: int = CARRIER):
    langs = sorted(dictionaries)

    def run(batches):
        packers = _Packers(dictionaries, level, carrier)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            best, least, second = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.inf), np.full(batch.num_rows, np.inf)
            for a, b in runs(off):
                parts = []
                for i in range(a, b):
                    raw = _letters(buf[off[i] : off[i + 1]].tobytes())
                    parts.append([raw[j : j + block] for j in range(0, len(raw), block)] if raw.strip() else [])
                for k, lang in enumerate(langs):  # one language after another, so that few compressors are held
                    compress, start, alone = packers.get(lang)
                    for i, texts in enumerate(parts, a):
                        if texts:
                            size = sum(len(compress(start + x)) - alone for x in texts)
                            if size < least[i]:
                                best[i], least[i], second[i] = k, size, least[i]
                            elif size < second[i]:
                                second[i] = size
            known = np.where(best < 0, 0.0, least)
            score = np.where(best < 0, 0.0, np.where(np.isinf(second), 1.0, 1 - known / np.maximum(second, 1)))
            pred = [langs[k] if k >= 0 else "und" for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs that identify() doesn't reject, with all their columns, whatever their names.

    Rows with a null text or one without letters are rejected; repeated rows stay or go together; no rows give no rows.
    """
    judge, names = predict(dictionaries), docs.columns

    @tidy
    def run(batches):
        for batch in batches:
            got = next(judge([batch.select(["doc_id", "text"])]))
            good = np.array([p != "und" for p in got.column(1).to_pylist()], bool) & (got.column(2).to_numpy() >= margin)
            yield batch.filter(pa.array(good)).select(names)

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text, ...).

    lang_pred is `und`, with score 0, where the text is null or has no letter, or nothing was learned. Ties go to the
    first language by name. Repeated rows get the same answer; no rows give no rows; other columns are ignored. A text of
    any length is encoded whole, block by block.
    """
    got = docs.select("doc_id", "text").mapInArrow(tidy(predict(dictionaries)), "doc_id long, lang_pred string, score double")
    return got.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < margin))
