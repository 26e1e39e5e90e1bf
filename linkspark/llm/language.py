"""Language identification by compression: the language whose dictionary makes a text smallest.

A language is a raw-content dictionary of its training text. Every whole text is cut into blocks, each block is
compressed with every dictionary, and the sizes are added up. The smallest sum wins; a text whose two smallest
sums lie close together is rejected.
"""

from __future__ import annotations

import re
from collections import defaultdict

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tables import held_out, per_text

#: Training documents of a language at most, and characters of each of them: the bounded training sample.
TRAINING_DOCS = 64
TRAINING_CHARS = 4096
#: Bytes of a language's dictionary.
DICTIONARY_BYTES = 32 << 10
#: Bytes compressed at a time; short blocks keep the dictionary in charge.
BLOCK = 1024
#: A text is rejected if the best sum is less than this share below the next best.
LEAST_MARGIN = 0.005
#: Margin at which the score is one half.
HALF_MARGIN = 0.02
UNKNOWN = "und"

NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words without digits and signs."""
    return NO_LETTERS.sub(" ", text).strip().lower().encode()


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """``(lang, text)`` of the training documents with the smallest hashes of each language."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), "text"), "text")
    return [
        (r.lang, r.text)
        for r in docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
        .select("lang", "doc_id", F.substring("text", 1, TRAINING_CHARS).alias("text"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= TRAINING_DOCS)
        .orderBy("lang", "n")
        .select("lang", "text")
        .collect()
    ]


def dictionaries(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    """Dictionary content by language, the language with most training text first."""
    found: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in sample:
        found[lang].append(letters(text))
    # every document gives an equal share of the dictionary at least
    content = {k: b" ".join(x[: max(256, DICTIONARY_BYTES // len(v))] for x in v)[:DICTIONARY_BYTES] for k, v in found.items()}
    return dict(sorted(content.items(), key=lambda x: (-len(found[x[0]]), x[0])))


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.content = content
        self.compressors: list[tuple[str, zstandard.ZstdCompressor]] | None = None

    def __getstate__(self):
        return {"content": self.content, "compressors": None}

    def load(self) -> None:
        self.compressors = []
        for lang, content in self.content.items():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                5, source_size=BLOCK, dict_size=DICTIONARY_BYTES, min_match=3, strategy=zstandard.STRATEGY_LAZY2,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            dictionary.precompute_compress(compression_params=how)
            self.compressors.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)))

    def sizes(self, text: str) -> list[tuple[int, int, str]]:
        """``(bytes, order, language)``, smallest first; ties go to the language with more training text."""
        if self.compressors is None:
            self.load()
        content = letters(text)
        blocks = [content[i : i + BLOCK] for i in range(0, len(content), BLOCK)]
        return sorted((sum([len(c.compress(b)) for b in blocks]), i, lang) for i, (lang, c) in enumerate(self.compressors))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is wide enough."""
        if text is None or not self.content or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        found = self.sizes(text)
        margin = 1.0 if len(found) == 1 else 1 - found[0][0] / max(1, found[1][0])
        return found[0][2], margin / (margin + HALF_MARGIN), margin >= LEAST_MARGIN


def train(docs: DataFrame) -> Classifier:
    return Classifier(dictionaries(training_sample(docs)))


def identify(docs: DataFrame, classifier: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``accepted`` of every whole text.

    A null text and one without a letter are ``und``, with score 0, and not accepted; so is every text if nothing
    was learned. Repeated rows give repeated rows.
    """
    return per_text(
        docs, keep, "lang_pred string, score double, accepted boolean",
        lambda texts: [classifier.classify(t) for t in texts], text,
    )
