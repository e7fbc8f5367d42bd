"""Operator 3: exact token counts of every prefix by dynamic programming.

For each text the operator stores count[i], the number of BPE tokens of its first i code points as
the tokenizer would give it for that prefix alone. Truncation points and budgets are then look-ups
in the array (`tokens_at`, `longest_within`): nothing is encoded again. The recurrence is
count[i] = count[i - len(t)] + 1, with t the token that ends at i (see `bpe.Vocabulary.prefixes`);
a text's array joins those of its pre-tokens.

The job is one map over the scan, without a shuffle; a lost executor costs only its own tasks.

Cases: a null text counts as the empty one, whose array is [0]. Repeated rows give repeated rows.
An empty table gives no rows. A null id stays. Other columns are left out, whatever their names. A very
long text, also one of many special strings or without a blank, takes time and memory in proportion to
its length (four bytes per code point).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.tables import by_size, read, special_tokens, whole_texts


def prefix_token_counts(docs: DataFrame, ranks_path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of UTF-8) and prefix_tokens, whose element i (from 0) is the count of the first i code points.

    ranks_path: the vocabulary as ranks; tokenizer_json: the same vocabulary's file that names its special tokens.
    """
    rows = whole_texts(docs, id_col, text_col)
    special = special_tokens(tokenizer_json)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        steps = bpe.table(bpe.StepTable, ranks_path)
        for part, texts in by_size(batches):
            counts = [bpe.prefix_counts(x, steps, special) for x in texts]
            ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(counts))
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, lists], ["doc_id", "n_bytes", "prefix_tokens"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, prefix_tokens array<int>")


def tokens_at(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """The token count of the first n_chars code points; null beyond the text."""
    return F.get(prefix_tokens, F.lit(n_chars) if isinstance(n_chars, int) else n_chars)


def all_tokens(prefix_tokens: Column) -> Column:
    return F.element_at(prefix_tokens, -1).cast("long")


def longest_within(prefix_tokens: Column, budget: int) -> Column:
    """The most code points that a prefix of at most `budget` tokens has (a longer prefix can have fewer tokens)."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = prefix_token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    n = all_tokens(F.col("prefix_tokens"))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 512).alias("over_limit"))
