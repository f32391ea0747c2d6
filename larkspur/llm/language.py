"""Language identification by compression.

For each language of the labelled rows a raw-content zstandard dictionary is filled with
whole normalised texts (at most ``per_language`` distinct labelled texts, taken by hash; one
that does not fit into what is left of ``capacity`` bytes is left out, and where none fits the
shortest is taken whole). A text is normalised (lower case; all but letters and their marks
becomes one blank), cut into blocks so that the dictionary counts for all of it, and encoded with every
dictionary. The language of the smallest encoding wins; equal sizes go to the language with
more labelled rows. Where the lead is a small part of the size, the row is marked rejected.

The label scan is a grouped count and a filtered read of few rows for each language; texts are
then read once and never shuffled. Every language with a labelled text is learned; each takes
about three times ``capacity`` of a worker's memory.

Null texts and texts without a letter are `und` with score 0, as are all rows where nothing
was learned. Labels that are null are not learned from. Repeated rows each get their row.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import bucket, map_pieces

FOLDS, HELD_OUT = 5, 0
PER_LANGUAGE = 120  # bound of the labelled texts in a dictionary
CAPACITY = 64 << 10
BLOCK = 2048
LEVEL = 6
NARROW = 0.01
UNKNOWN = "und"
_OPENING = b"0" * 32  # a compressible start, so that short blocks are encoded and not stored

_KEEP = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def _ranges(kinds: str) -> str:
    """A character class of all code points of some Unicode kinds."""
    inside = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
    edges = [i for i in range(len(inside)) if not i or inside[i] != inside[i - 1] + 1] + [len(inside)]
    return "".join(f"{re.escape(chr(inside[a]))}-{re.escape(chr(inside[b - 1]))}" for a, b in zip(edges, edges[1:]))


@lru_cache(1)
def _letters() -> re.Pattern:
    return re.compile(f"[{_ranges('LM')}]+")


def normalised(text: str) -> bytes:
    if text.isascii():
        return b" ".join(text.lower().encode().translate(_KEEP).split())
    return " ".join(_letters().findall(text.lower())).encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], rows: dict[str, int]):
        # more rows first: min() then breaks ties that way
        self.dictionaries, self.rows = dictionaries, rows
        self.names = sorted(dictionaries, key=lambda k: (-rows.get(k, 0), k))
        self.coders = []
        for name in self.names:
            data = dictionaries[name]
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(data), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=raw))

    def sizes(self, text: str) -> list[int]:
        data = normalised(text)
        blocks = [_OPENING + data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if text is None or not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(math.exp(max(-60.0, -0.5 * (s - sizes[best]))) for s in sizes)
        rest = [s for i, s in enumerate(sizes) if i != best]
        return self.names[best], score, bool(rest) and min(rest) - sizes[best] < NARROW * sizes[best]


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out=None, per_language: int = PER_LANGUAGE, capacity: int = CAPACITY) -> Classifier:
    own = docs if held_out is None else docs.where(~held_out)
    scale = 1 << 40
    place = F.pmod(F.xxhash64("key", "text"), F.lit(scale))
    known = own.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("place", place)
    seen = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("places")).collect()  # a row a language
    if not seen:
        return Classifier({}, {})
    # The share of hashes that holds enough rows of each language, then its first by hash.
    share = F.create_map(*[F.lit(x) for r in seen for x in (r.lang, min(scale, math.ceil(scale * 2 * (per_language + 20) / r.places)))])
    near = known.where(F.col("place") < share[F.col("lang")]).groupBy("lang", "text").agg(F.min("place").alias("place"))
    first = Window.partitionBy("lang").orderBy("place", "text")
    chosen = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)
    texts: dict[str, list] = {}
    for r in chosen.orderBy("lang", "rank").toLocalIterator():
        texts.setdefault(r.lang, []).append(normalised(r.text) + b" ")
    dictionaries = {}
    for k, own in texts.items():
        data = b""
        for t in own:
            if len(data) + len(t) <= capacity:
                data += t
        dictionaries[k] = data if data.strip() else min(own, key=lambda t: (len(t) < 2, len(t)))
    return Classifier({k: v for k, v in dictionaries.items() if v.strip()}, {r.lang: r.n for r in seen})


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out=None) -> DataFrame:
    """Per document: lang_pred, score (0 to 1) and rejected."""
    model = learn(docs, key, text, lang, held_out)
    shared = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.rows))

    def make():
        classifier = Classifier(*shared.value)

        def kernel(batch, buf, off):
            out = [classifier.classify(t) for t in batch.column("text").to_pylist()]
            names, scores, rejected = zip(*out)
            return {"lang_pred": names, "score": np.array(scores), "rejected": rejected}

        return kernel

    return map_pieces(docs.select(key, F.col(text).alias("text")), "text", [key], "lang_pred STRING, score DOUBLE, rejected BOOLEAN", make)


def predictions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of op6."""
    held = F.coalesce(bucket(key, FOLDS) == HELD_OUT, F.lit(False))  # rows without an id are learned from
    return identify(docs, key, held_out=held).select(key, held.alias("held_out"), "lang_pred", "score", "rejected")
