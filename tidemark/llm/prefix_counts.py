"""Exact token counts of every prefix of a text, by prefix dynamic programming over a merge vocabulary.

Method. The tokenizer merges neighbouring symbols, the best-scored pair first and the leftmost of
equal ones, so a sequence of pieces is the encoding of its text exactly if every piece and every two
neighbours encode to themselves. Hence each prefix has one last piece: the piece that ends there and
fits behind the last piece of the prefix before it. One pass over the positions thus gives the count
of each prefix from the count of an earlier one, and `prefix_table` stores them. `tokens_of_prefix`
(what does a cut text cost), `longest_within` (where to cut for a budget) and `first_over` then
answer from the stored counts, without encoding anything again. As a longer prefix may have fewer
tokens, `longest_within` gives the last position within the budget, not the first one before it is passed.

Pieces of the vocabulary have spaces in front only (checked when it is loaded), so counts of a space
run with the word behind it do not depend on what stands around them; they are kept in a bounded
cache. Characters without a piece cost one token per UTF-8 byte.

Special cases. Null text counts as empty: no tokens, no prefixes. Positions are code points of the
text; position 0 has no tokens. Very long texts and words take time in proportion to their length.
Repeated rows and null ids are kept as they are; an empty table gives an empty table; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, per_text

SPACE = "▁"
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
WORDS, PAIRS = 300_000, 300_000


class Vocabulary:
    """Scores of the mergeable pieces of a model file, and which pieces stand for themselves."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                      if not any(kind(i) for kind in special)}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece crosses the border between a word and the space behind it")
        self.fits = Memo(self._fits, PAIRS)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text, merged one pair at a time."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether a piece (the second) may follow another; the first is empty at the start."""
        before, piece = pair
        return self.merge(before + piece) == ([before, piece] if before else [piece])

    def cost(self, piece: str) -> int:
        return 1 if piece in self.score else len(piece.encode())

    def prefixes(self, run: str) -> list[int]:
        """Token count of each non-empty prefix of a space run with its word."""
        score, fits, longest = self.score, self.fits, self.longest
        count, last = [0], [""]
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - longest), end):
                piece = run[start:end]
                if (piece in score or start == end - 1) and fits[last[start], piece]:
                    count.append(count[start] + self.cost(piece))
                    last.append(piece)
                    break
        return count[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def runs_of(text: str) -> list[str]:
    """Space runs with the words behind them; the tokenizer puts one space before the text."""
    return RUN.findall(SPACE + text.replace(" ", SPACE))


def prefix_counter(path: str) -> Callable[[str | None], tuple[list[int]]]:
    """text -> its counts at positions 1, 2, ... (in a tuple, as one row)."""
    counts = Memo(vocabulary(path).prefixes, WORDS // 4)

    def one(text: str | None):
        out, before = [], 0
        for run in runs_of(text) if text else ():
            here = counts[run]
            out += [before + n for n in here] if before else here[1:]  # the space in front is not in the text
            before += here[-1]
        return (out,)
    return one


@lru_cache(maxsize=2)
def total_counter(path: str) -> Callable[[str | None], tuple[int]]:
    """text -> the count at its last position. Kept for the life of a worker process, so its tasks share the counted words."""
    prefixes = vocabulary(path).prefixes
    last = Memo(lambda run: prefixes(run)[-1], WORDS)

    def one(text: str | None):
        return (sum(map(last.__getitem__, runs_of(text))) if text else 0,)
    return one


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, counts (array<int>: token count of each prefix, by code points)."""
    return docs.select("doc_id", per_text(lambda: prefix_counter(path), "counts array<int>")("text")["counts"].alias("counts"))


def token_totals(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens: the last stored count alone."""
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                       per_text(lambda: total_counter(path), "n long")("text")["n"].alias("n_tokens"))


# ------------------------------------------------------------------ questions to stored counts
def tokens_of_prefix(counts: Column, length: Column) -> Column:
    """Tokens of the first `length` code points (all of them if the text is shorter)."""
    at = F.least(length, F.size(counts))
    return F.when(at < 1, F.lit(0)).otherwise(F.get(counts, at - 1))


def longest_within(counts: Column, budget: int) -> Column:
    """The largest number of leading code points that take at most `budget` tokens."""
    back = F.array_position(F.transform(F.reverse(counts), lambda n: n <= budget), True)
    return F.when(back == 0, F.lit(0)).otherwise(F.size(counts) - back.cast("int") + 1)


def first_over(counts: Column, budget: int) -> Column:
    """The first number of leading code points that takes more than `budget` tokens; null if none does."""
    return F.nullif(F.array_position(F.transform(counts, lambda n: n > budget), True).cast("int"), F.lit(0))
