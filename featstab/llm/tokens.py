"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token that goes with the last token of what precedes it, so a text is walked once:
every vocabulary entry that ends at a byte (found by one automaton) is tried against the encoding stored where it begins, and the
count there plus one is the prefix's count. Two tokens go together if merging their bytes never joins across their border, which the
merge ranks along the border decide. Stored counts answer where a text must be cut for any limit, and what a budget of tokens covers,
without encoding anything again.

Texts are divided as the tokenizer's pattern divides them, and repeated pieces are answered from a bounded memory.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featstab.functions.prefix import running

from .common import small_batches, table

#: The file's own division, in units of white space and what follows it: contractions first; white space before a word is the word's
#: if it ends in a blank, else it stands alone.
UNIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)|(?:\s* )?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
#: Characters whose class is the same in every version of Unicode; the class of others is asked of the tokenizer library.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
#: Units and token pairs that a worker remembers, and the longest unit that it remembers; beyond them memory starts anew.
UNITS, PAIRS, LONGEST = 1 << 19, 1 << 20, 128


class _Classes(dict):
    """Character number to a plain character of its class (letter, number, white space, other), as the library divides texts."""

    def __init__(self, divide):
        self.divide = divide

    def __missing__(self, number: int) -> str:
        c = chr(number)
        if not PLAIN.search(c):
            found = c
        else:
            pieces = [c2 for _, c2 in self.divide("a" + c + c + "a")]
            if len(pieces) == 1:
                found = "a"
            elif pieces[1][1] - pieces[1][0] == 1:
                found = "\n"
            else:
                found = "1" if len(self.divide("1" + c)) == 1 else "!"
        self[number] = found
        return found


class _Units(dict):
    """Unit to its prefix counts, as bytes of int32, and its count before more text; bounded."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, unit: str) -> tuple[bytes, int]:
        return self.shaped(unit, unit)

    def shaped(self, unit: str, shape: str) -> tuple[bytes, int]:
        """Count a new unit, ``shape`` of which is the same with a plain character for each."""
        found = self.count(unit, shape)
        if len(unit) <= LONGEST:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = found
        return found


class Follows(dict):
    """Of a token: which tokens are known to go, or not to go, behind it."""

    def __init__(self, token: int):
        self.token = token


class PrefixCounter:
    """Counts for one byte-level BPE file. Raises ValueError for files with settings that this does not follow."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, divider, added = file["model"], file["pre_tokenizer"], file.get("added_tokens") or []
        plain = divider and divider["type"] == "ByteLevel" and not divider["add_prefix_space"] and divider.get("use_regex", True)
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        names = [t["content"] for t in added]
        if model["type"] != "BPE" or not plain or odd or file.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added) or any(a != b and a in b for a in names for b in names):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        divide = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = _Classes(divide)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes written as themselves; the rest from U+0100 on
        byte = {ord(chr(b)): b for b in shown} | {256 + i: b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ids = model["vocab"]
        self.rank, self.parts, self.pairs = {}, {}, {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            if max(self.rank.get(left, -1), self.rank.get(right, -1)) >= k:
                raise ValueError(f"{path}: merge {k} joins what later merges make")
            self.pairs[left << 32 | right] = k
            self.rank.setdefault(whole, k)
            self.parts.setdefault(whole, (left, right))
        self.automaton, self.follows, self.n_pairs = ahocorasick.Automaton(), [], 0
        reached: set[int] = set()
        for piece, token in sorted(ids.items(), key=lambda x: self.rank.get(x[1], -1)):
            if piece in names:
                continue
            parts = self.parts.get(token)
            if parts is None and len(piece) > 1 or parts and not (parts[0] in reached and parts[1] in reached and self.apart(*parts, self.rank[token])):
                continue  # no text's encoding has it
            reached.add(token)
            self.follows.append(Follows(token))
            self.automaton.add_word(piece.translate(byte), (token, len(piece), self.follows[-1]))
        self.automaton.make_automaton()
        self.units = _Units(self.of_unit)

    def apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether merging the bytes of tokens a and b, with merges of ranks under ``before``, never joins across their border.

        Walks back in time: the later made of the two pieces at the border is replaced by its part there. A border merge must come
        before either piece is used up; of equal merges the one further left comes first, and of two equal tokens the left one is made first."""
        over_a = over_b = before
        while True:
            k = self.pairs.get(a << 32 | b)
            if k is not None and k < over_a and k < over_b:
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                over_a, a = rank_a, self.parts[a][1]
            else:
                over_b, b = rank_b + 1, self.parts[b][0]

    def of_piece(self, piece: str) -> list[int]:
        """Token count of the prefix of 0, 1, ... characters of a piece that the pattern leaves whole."""
        raw = piece.encode()
        n = len(raw)
        after, count, done = [None] * (n + 1), [0] * (n + 1), 0
        for end, (token, length, follows) in self.automaton.iter(raw.decode("latin-1")):
            if end < done:  # the one token that may end here is found
                continue
            start = end + 1 - length
            if start:
                good = after[start].get(token)
                if good is None:
                    good = self.learn(after[start], token)
                if not good:
                    continue
            done = end + 1
            after[done], count[done] = follows, count[start] + 1
        if n == len(piece):
            return count
        ends = [i for i in range(1, n) if raw[i] & 0xC0 != 0x80] + [n]
        return [0, *(count[i] for i in ends)]

    def learn(self, follows: Follows, token: int) -> bool:
        """Decide a pair and remember it."""
        if self.n_pairs >= PAIRS:
            for each in self.follows:
                each.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        good = follows[token] = self.apart(follows.token, token)
        return good

    def of_unit(self, unit: str, shape: str) -> tuple[bytes, int]:
        """Counts of the prefixes of a unit, as int32 bytes, and what it counts when something follows.

        Prefixes are divided as texts that end there: white space is whole, an unfinished contraction is an apostrophe and letters."""
        space = len(shape) - len(shape.lstrip("\t\n\r "))
        if space == len(shape):
            counts = self.of_piece(unit)
            behind = counts[-2] + self.of_piece(unit[-1])[-1]  # followed by another character, its last stands alone
        elif space > 1:
            blank = self.of_piece(unit[:space])
            word = self.of_piece(unit[space - 1 :])
            counts = blank + [blank[space - 1] + c for c in word[2:]]
            behind = counts[-1]
        elif len(unit) > 1 and unit[0] == "'" and shape[1] in "sdmtlvr" and shape in ("'s", "'d", "'m", "'t", "'ll", "'ve", "'re"):
            counts = self.of_piece("'")
            if len(unit) == 3:
                counts = counts + [counts[1] + self.of_piece(unit[1])[-1]]
            counts = counts + [self.of_piece(unit)[-1]]
            behind = counts[-1]
        else:
            counts = self.of_piece(unit)
            behind = counts[-1]
        return array("i", counts[1:]).tobytes(), behind

    def of_segment(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters of a text without added tokens."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if PLAIN.search(text):
            shape = text.translate(self.classes)
            spans = [m.span() for m in UNIT.finditer(shape)]
            found = [self.units.get(text[a:b]) or self.units.shaped(text[a:b], shape[a:b]) for a, b in spans]
        else:
            found = list(map(self.units.__getitem__, UNIT.findall(text)))
        each, behind = zip(*found, strict=True)
        counts = np.frombuffer(b"".join(each), dtype=np.int32)
        before = np.cumsum(np.array((0, *behind[:-1]), dtype=np.int32), dtype=np.int32)
        return counts + np.repeat(before, np.fromiter(map(len, each), dtype=np.int64, count=len(each)) >> 2)

    def __call__(self, text: str) -> np.ndarray:
        """Token count of the prefix of 1, 2, ... characters: entry i - 1 is what the library gives for text[:i].

        A string of an added token is one token, as the library's default has it; its own unfinished prefixes are ordinary text."""
        if self.added is None or not self.added.search(text):
            return self.of_segment(text)
        parts, out, base = self.added.split(text), [], 0
        for k in range(0, len(parts), 2):
            follows = parts[k + 1] if k + 1 < len(parts) else ""
            here = self.of_segment(parts[k] + follows[:-1]) + np.int32(base)
            out.append(here)
            if follows:
                base = (int(here[len(parts[k]) - 1]) if parts[k] else base) + 1
                out.append(np.array([base], dtype=np.int32))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each file and worker."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", counts: bool = True, limits: tuple[int, ...] = ()) -> DataFrame:
    """A row per document: key, n_bytes (UTF-8), n_chars, n_tokens; with ``counts`` also the token count of the prefix of 1, 2, ...
    characters; for each of ``limits`` the characters ``chars_<limit>`` of the longest prefix with so many tokens or fewer.

    Counts are those of the tokenizer library without added special tokens, truncation or padding; strings of added tokens in a text
    are one token each. A prefix's count can be above that of a longer one, so the longest prefix is looked for from the end. Null and
    empty texts have 0 of everything and an empty array. Repeated rows give repeated results, a null key stays null, other columns are
    not read, so their names cannot clash. An empty table gives an empty result. No shuffle; memory is one batch of texts, the counts of
    one text (4 bytes a character) and a bounded memory of pieces. ``tokenizer`` is a path that every worker can open."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(text)
            found, numbers = [], []
            for t in texts:
                each = count(t.as_py() or "")
                numbers.append((len(each), int(each[-1]) if len(each) else 0, *(int(fits[-1]) + 1 if len(fits := np.nonzero(each <= limit)[0]) else 0 for limit in limits)))
                if counts:
                    found.append(each)
            columns = {key: batch.column(key), "n_bytes": pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())}
            columns |= {name: pa.array([r[i] for r in numbers], pa.int64()) for i, name in enumerate(("n_chars", "n_tokens", *(f"chars_{x}" for x in limits)))}
            if counts:
                columns["counts"] = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_chars long, n_tokens long" + "".join(f", chars_{x} long" for x in limits) + ", counts array<int>" * counts
    return docs.select(key, text).mapInArrow(run, schema)


def tokens_in(counts: Column, chars: Column) -> Column:
    """Tokens of the prefix of ``chars`` characters, from stored counts; null beyond the text."""
    return F.when(chars == 0, F.lit(0)).when((chars > 0) & (chars <= F.size(counts)), F.try_element_at(counts, chars.cast("int")))


def longest_within(counts: Column, limit: Column) -> Column:
    """Characters of the longest prefix with ``limit`` tokens or fewer, from stored counts."""
    fits = F.transform(counts, lambda c, i: F.when(c <= limit, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))


def within_budget(stored: DataFrame, budget: int, order: list[Column], key: str = "doc_id") -> DataFrame:
    """What a budget of tokens covers of documents in ``order``: key, n_tokens, tokens_before, chars_taken, tokens_taken.

    ``stored`` is what prefix_counts() gives, with any columns that ``order`` needs. Documents are taken whole while the running total
    stays within the budget; the next is cut at its longest prefix that still fits; later ones have 0. Running totals are made partition
    by partition (functions.prefix) without the arrays of counts; only the one document that is cut has its array read. Rows that tie in
    ``order`` stand in any order; of rows equal in key, n_chars and n_tokens the largest array serves."""
    total = running(stored.drop("counts"), order, position=None, _through=("sum", "n_tokens"))
    before = F.col("_through") - F.col("n_tokens")
    total = total.select(key, "n_chars", "n_tokens", before.alias("tokens_before"), "_through")
    is_cut = (F.col("tokens_before") < budget) & (F.col("_through") > budget)
    one = total.where(is_cut).select(F.col(key).alias("_k"), F.col("n_chars").alias("_c"), F.col("n_tokens").alias("_n"), (F.lit(budget) - F.col("tokens_before")).alias("_left"))  # at most one row
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("n_chars") == F.col("_c")) & (F.col("n_tokens") == F.col("_n"))
    cut = stored.join(F.broadcast(one), same).groupBy("_k", "_c", "_n", "_left").agg(F.max("counts").alias("_counts"))
    chars = longest_within(F.col("_counts"), F.col("_left")).cast("long")
    cut = cut.select("_k", "_c", "_n", chars.alias("_chars"), tokens_in(F.col("_counts"), chars).cast("long").alias("_tokens"))
    none, whole = F.lit(0).cast("long"), F.col("_through") <= budget
    out = total.join(F.broadcast(cut), same & is_cut, "left")
    return out.select(key, "n_tokens", "tokens_before", F.when(whole, F.col("n_chars")).otherwise(F.coalesce("_chars", none)).alias("chars_taken"), F.when(whole, F.col("n_tokens")).otherwise(F.coalesce("_tokens", none)).alias("tokens_taken"))


def op12_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    found = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), counts=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
