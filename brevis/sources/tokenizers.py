"""Byte-level BPE vocabularies: read from tokenizer JSON, or a small built-in one."""

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import byte_alphabet, decode_bytes, encode_bytes

#: A small vocabulary's merges, by rank.
MERGES = ["Ġ t", "h e", "i n", "r e", "o n", "e r", "Ġt he", "a n", "Ġ a", "n d", "e n", "i e", "t i", "o u", "s t", "Ġ o", "Ġo f", "in g", "e s", "ti on"]
OPEN, CLOSE = "\x01", "\x02"
#: Runs that a worker remembers, and their characters at most.
KEPT, LONGEST_KEPT = 200_000, 64
#: Beyond so many merges nested expressions grow too deep, and the Arrow form is used.
MOST_NESTED = 200


class Tokenizer:
    """Merges by rank, and ids of tokens. `added` are tokens beside the model's vocabulary; texts never give them, and decoding skips them."""

    def __init__(self, vocab: dict[str, int], merges: list[str] | list[list[str]], added: dict[str, int] | None = None):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {p: k for k, p in enumerate(pairs)}  # of equal pairs the last rank holds
        self.merges = sorted(self.ranks, key=self.ranks.get)
        self.vocab, self.tokens, self.added = vocab, {i: t for t, i in vocab.items()}, added or {}
        #: The last and the first character of all pairs that merge: nothing merges across any other pair of characters.
        self.joints = {(a[-1], b[0]) for a, b in self.ranks}
        self.known: dict[str, list[str]] = {}
        if missing := [c for c in byte_alphabet() if c not in vocab]:
            raise ValueError(f"{len(missing)} bytes have no token")

    @property
    def size(self) -> int:
        return len(self.vocab)

    @property
    def ordered(self) -> bool:
        """Whether one pass in rank order gives what repeated lowest-rank merging gives: results are unique, and parts come before their merges."""
        made, seen = {a + b: k for k, (a, b) in enumerate(self.merges)}, set(byte_alphabet())
        if len(made) < len(self.merges):
            return False
        for a, b in self.merges:
            if not {a, b} <= seen:
                return False
            seen.add(a + b)
        return True

    @property
    def native(self) -> bool:
        return len(self.merges) <= MOST_NESTED and self.ordered

    def apply(self, parts: list[str]) -> list[str]:
        """Merges the lowest-ranked neighbouring pair everywhere, left to right, until none is left.

        The pairs wait in a heap by rank and place, and the parts are a linked list, so a text takes n log n steps. Within a
        round of one rank only pairs that stood at its beginning are merged; those that it makes come in a later round.
        """
        n, ranks, alive = len(parts), self.ranks, list(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, due = heap[0][0], []
            while heap and heap[0][0] == rank:
                due.append(heapq.heappop(heap))
            made = []
            for _, i, a, b in due:
                j = after[i]
                if j < 0 or alive[i] != a or alive[j] != b:
                    continue
                alive[i], alive[j], after[i] = a + b, None, after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                made.append(i)
            for i in made:
                for x in (before[i], i):
                    if alive[i] is not None and x >= 0 and (y := after[x]) >= 0 and (r := ranks.get((alive[x], alive[y]))) is not None:
                        heapq.heappush(heap, (r, x, alive[x], alive[y]))
        return [t for t in alive if t is not None]

    def split(self, chars: str) -> list[str]:
        """The tokens of characters of the byte alphabet: runs that no merge can leave are merged once each and kept, in bounded memory."""
        joints, known, out, begin = self.joints, self.known, [], 0
        for end in [*(i for i, p in enumerate(zip(chars, chars[1:]), 1) if p not in joints), len(chars)]:
            run = chars[begin:end]
            if (got := known.get(run)) is None:
                if len(known) >= KEPT:
                    known.clear()
                got = self.apply(list(run))
                if len(run) <= LONGEST_KEPT:
                    known[run] = got
            out += got
            begin = end
        return out

    def encode(self, chars: str) -> list[int]:
        """Ids of characters of the byte alphabet; a token that isn't in the vocabulary gives the ids of its characters."""
        out = []
        for t in self.split(chars):
            i = self.vocab.get(t)
            out += [i] if i is not None else [self.vocab[c] for c in t if c in self.vocab]
        return out

    def pieces(self, text: Column) -> Column:
        """The tokens of a text as an array of strings; none for empty texts."""
        if not self.native:
            return self._by_batch(self.split, "array<string>")(encode_bytes(text))
        marked = F.regexp_replace(encode_bytes(text), "(?s)(.)", f"{OPEN}$1{CLOSE}")
        for a, b in self.merges:
            marked = F.replace(marked, F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}"), F.lit(f"{OPEN}{a}{b}{CLOSE}"))
        return F.array_remove(F.split(F.translate(marked, OPEN, ""), CLOSE), "")

    @staticmethod
    def _by_batch(one, kind: str):
        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else one(v) for v in values])

        return run

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.vocab.items(), key=lambda x: x[1]), "token string, id int")

    def look_up(self, rows: DataFrame) -> DataFrame:
        """Rows with `id`, or with `token`, and the other one of the two; null where the vocabulary has none."""
        on = "id" if "id" in rows.columns else "token"
        return rows.join(F.broadcast(self.table(rows.sparkSession)), on, "left")

    def ids(self, text: Column) -> Column:
        """Token ids; a token that isn't in the vocabulary gives the ids of its characters."""
        if not self.native:
            return self._by_batch(self.encode, "array<int>")(encode_bytes(text))
        known = F.create_map(*(F.lit(x) for t, i in self.vocab.items() for x in (t, i)))
        one = lambda t: F.when(F.map_contains_key(known, t), F.array(F.try_element_at(known, t))).otherwise(F.filter(F.transform(F.split(t, ""), lambda c: F.try_element_at(known, c)), lambda i: i.isNotNull()))
        return F.flatten(F.transform(self.pieces(text), one))

    def text(self, ids: Column) -> Column:
        """The text of token ids; unknown ids are skipped."""
        if not self.native:
            tokens = self.tokens
            return decode_bytes(self._by_batch(lambda v: "".join(tokens.get(i, "") for i in v), "string")(ids))
        known = F.create_map(*(F.lit(x) for i, t in self.tokens.items() for x in (i, t)))
        return decode_bytes(F.array_join(F.filter(F.transform(ids, lambda i: F.try_element_at(known, i)), lambda t: t.isNotNull()), ""))


def small() -> Tokenizer:
    """256 byte tokens and the built-in merges."""
    tokens = [*byte_alphabet(), *(m.replace(" ", "") for m in MERGES)]
    return Tokenizer({t: i for i, t in enumerate(tokens)}, MERGES)


def load(spark: SparkSession, path: str) -> Tokenizer:
    """A tokenizer JSON (model.vocab, model.merges, added_tokens) from any store that Spark reads. One file of bounded size."""
    import json

    whole = json.loads(spark.read.text(path, wholetext=True).first().value)
    return Tokenizer(whole["model"]["vocab"], whole["model"]["merges"], {t["content"]: t["id"] for t in whole.get("added_tokens") or []})
