"""Stupid-backoff scores of documents, from n-gram counts over all of them.

The count table is partitioned by hash: each batch of documents joins its own distinct words, pairs and triples to
it (see ``tally``) and gets their counts back, so the table grows with the corpus and is never broadcast. Every
count above 0 counts. Then each document's n-grams are scored and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from twintable.llm import repeats, tally
from twintable.llm.base import gram_hashes, mixed, release_memory, word_hashes

ALPHA = 0.4
#: N-grams of two words and more count from so many occurrences on: 1 is the measure itself, more is the user's choice.
LEAST = 1
#: Bytes of text in a batch: the larger it is, the fewer n-grams are asked for twice.
BATCH_BYTES = 16 << 20


def _grams(rows: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    """Number of words of each row; hashes of all words, then of the pairs, then of the triples that lie within a row."""
    words = [word_hashes((t or "").encode())[0] for t in rows["text"]]
    ones = [mixed(w ^ np.uint64(0x517CC1B727220A95)) for w in words]
    parts = ones + [gram_hashes(w, 2) for w in words] + [gram_hashes(w, 3) for w in words]
    return [len(w) for w in words], np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """One row per input row: key, n_words, log_score (sum of the logarithms of the scores of its words) and
    mean_score (per word).

    A word's score is c(abc) / c(ab) if c(abc) reaches ``least``; else ``alpha`` times c(bc) / c(b) if c(bc)
    reaches it; else ``alpha`` again times c(c) / N. A document's first word has no context and its second one
    word of it, without a factor for what is missing. Words are parted by ASCII white space and unchanged; all rows
    are counted and scored, repeated ones and null keys too. Null, empty and blank texts have no words: 0, 0 and null.
    """
    batches, total = repeats.prepared(docs, key, text, batch_bytes=BATCH_BYTES)
    buckets = tally.buckets_for(total)

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        sizes, grams = _grams(rows)
        return tally.question(rows["batch"].iloc[0], grams, buckets, total=sum(sizes))

    def judge(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        sizes, grams = _grams(rows)
        counts = tally.answer(grams, answers, total=True).astype(float)
        del grams
        n_ones, n_pairs, every = sum(sizes), sum(max(0, n - 1) for n in sizes), counts[-1]
        one, pair, triple = counts[:n_ones], counts[n_ones:n_ones + n_pairs], counts[n_ones + n_pairs:-1]
        found, a, b, c = [], 0, 0, 0
        for n in sizes:
            ones, pairs, threes = one[a:a + n], pair[b:b + max(0, n - 1)], triple[c:c + max(0, n - 2)]
            a, b, c = a + n, b + len(pairs), c + len(threes)
            s = ones / every if n else ones
            if n > 1:
                s[1:] = np.where(pairs >= least, pairs / ones[:-1], alpha * s[1:])
            if n > 2:
                s[2:] = np.where(threes >= least, threes / pairs[:-1], alpha * s[2:])
            total_log = float(np.log(s).sum())
            found.append((n, total_log, total_log / n if n else None))
        out = pd.DataFrame(found, columns=["n_words", "log_score", "mean_score"])
        out.insert(0, "key", rows["key"].astype("Int64").reset_index(drop=True))
        return out

    counts = tally.totals(batches.groupBy("batch").applyInPandas(ask, tally.ASKED))
    return batches.groupBy("batch").cogroup(counts.groupBy("batch")).applyInPandas(
        judge, "key long, n_words long, log_score double, mean_score double")


def brute_force(texts: list[str | None], least: int = LEAST, alpha: float = ALPHA) -> Iterator[tuple[int, float]]:
    """(words, sum of logarithms) of each text, word by word, for tests."""
    from collections import Counter
    from math import log

    words = [(t or "").encode().split() for t in texts]
    counts: Counter = Counter()
    for w in words:
        for n in (1, 2, 3):
            counts.update(zip(*(w[k:] for k in range(n)), strict=False))
    every = sum(map(len, words))
    for w in words:
        total = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(i, 2), -1, -1):
                gram = tuple(w[i - n:i + 1])
                if n == 0:
                    total += log(factor * counts[gram] / every)
                elif counts[gram] >= least:
                    total += log(factor * counts[gram] / counts[gram[:-1]])
                    break
                factor *= alpha
        yield len(w), total
