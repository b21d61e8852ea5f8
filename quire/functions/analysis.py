"""Turning text into search terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.stem import stem

TOKEN_BREAK = r"[^\p{L}\p{N}]+"

# The English stop words of the text search configuration.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now",
)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    """Stem the distinct tokens of a batch and put the stems back in place."""
    flat = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(t) for t in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    sizes = np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), stems, mask=tokens.is_null() if tokens.null_count else None
    )


@dataclass(frozen=True)
class Analyzer:
    """How documents and queries are cut into terms; both sides must use the same one.

    Stemming runs in place, on the distinct tokens of each Arrow batch, so it
    needs no shuffle of the vocabulary.
    """

    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS
    stemmed: bool = False

    def tokens(self, text: Column) -> Column:
        stop_words = self.stop_words
        # stop words are part of one IN list, which the optimizer turns into a hash set
        kept = F.filter(
            F.split(F.lower(text), TOKEN_BREAK),
            lambda t: ~t.isin("", *stop_words),
        )
        return _stemmed(kept) if self.stemmed else kept

    def distinct_terms(self, text: Column) -> Column:
        """Sorted distinct terms: what a query asks for."""
        return F.sort_array(F.array_distinct(self.tokens(text)))


PLAIN = Analyzer()
ENGLISH = Analyzer(stemmed=True)
