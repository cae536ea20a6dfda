r"""Cross-tokenizer alignment by elementary intervals, and how well each link agrees with the rest of the corpus.

Two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), cut the same bytes: a space and the text. The union of both
arrays of token ends cuts the bytes into elementary intervals, each the overlap of the A token and the B token that own it, found
by searchsorted. An end that both arrays have closes a group, and the tokens of either side that end there are linked, all with
all (tokens without bytes can share an end).

The ids that a link joins are counted over the whole corpus, then each text's links are looked up in those counts. Two linked
tokens end together, so the bytes of one are a suffix of the other's: the vocabularies bound the different pairs (`most_pairs`,
about 275,000 for the files used), whatever the corpus. The counts are broadcast up to that proven bound.

Texts are cut into words: a cut stands between a character that isn't white space and a space. The pattern of A ends a match
there, and no entry of B has a space after another character, so no merge of either crosses it. Both sides have an end there,
so groups don't cross it either, and each different word is encoded and aligned once while a worker remembers it. The space
goes to the word after the cut, where it is the one that B puts before every text.

Cases: null and empty texts, and texts of which either tokenizer doesn't give the bytes back (B writes U+2581 as a space), have
no tokens: zeros and an empty digest; a text without any cut is encoded as one word, however long; rows that repeat an id stay rows of their
own, and each counts; extra columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, text_of, written

#: So many words a worker remembers, none longer than LONGEST code points; the others are encoded each time.
REMEMBERED, LONGEST = 400_000, 40
#: Code points of the texts that are aligned together.
TOGETHER = 1 << 18
#: A pair of ids as one number: A's id times this, plus B's id.
WIDE = 1 << 24
#: A cut has a character after its space: a last space stays with the word before it.
_CUT = re.compile(r"(?<=\S)\x20(?=[\s\S])")
#: White space before a space or at the end: elsewhere each space is a cut.
_UNEVEN = re.compile(r"\s(?:\x20|\Z)")
_loaded: dict = {}
_words: dict = {}


def files(a_path: str | None = None, b_path: str | None = None) -> tuple[bytes, bytes]:
    """Both vocabulary files (a few megabytes), read once on the driver and shipped with the tasks."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    out = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow U+0100 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: ids of many texts, and the bytes of each id."""

    def __init__(self, encode, entries: list[bytes]):
        self.encode, self.entries = encode, entries
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        # Ids as written in a digest, with what may follow: another of the same side, the other side, the next group, nothing.
        self.names = np.array([[f"{k}{mark}".encode() for k in range(len(entries))] for mark in (",", "|", ";", "")], dtype=object)


def sides(of_files: tuple[bytes, bytes]) -> tuple[Side, Side]:
    """Both tokenizers, made once in each worker process."""
    key = tuple(map(hash, of_files))
    if key not in _loaded:
        _loaded[key] = (_side_a(of_files[0]), _side_b(of_files[1]))
    return _loaded[key]


def _side_a(model: bytes) -> Side:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(model.decode())
    coder.encode_special_tokens = True
    letters, vocabulary = byte_letters(), coder.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for word, k in vocabulary.items():
        entries[k] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    return Side(lambda texts: [e.ids for e in coder.encode_batch([" " + t for t in texts], add_special_tokens=False)], entries)


def _side_b(model: bytes) -> Side:
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=model)
    entries = []
    for k in range(coder.get_piece_size()):
        piece = coder.id_to_piece(k)
        entries.append(bytes([int(piece[3:5], 16)]) if coder.is_byte(k) else piece.replace("▁", " ").encode())
    if any(re.search(rb"[^ ] ", e) for e in entries):
        raise ValueError("an entry goes on after a space, so texts can't be cut there")
    return Side(lambda texts: coder.encode(texts, num_threads=1), entries)


def most_pairs(a: Side, b: Side) -> int:
    """No corpus links more different pairs of ids: of a linked pair one entry is a suffix of the other, or has no bytes."""
    times = [Counter(e for e in side.entries if e) for side in (a, b)]
    suffixes = lambda entries, of, least: sum(of.get(e[k:], 0) for e in entries for k in range(least, len(e)))
    empty = [sum(not e for e in side.entries) for side in (a, b)]
    return suffixes(a.entries, times[1], 0) + suffixes(b.entries, times[0], 1) + empty[0] * len(b.entries) + empty[1] * len(a.entries)


def words_of(text: str) -> list[str]:
    """The text cut at single spaces, which belong to neither word; joined by spaces, the words are the text."""
    if not _UNEVEN.search(" " + text):
        return text.split(" ")
    first, *rest = _CUT.split(" " + text)
    return [first[1:], *rest]


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the elementary intervals of two sorted arrays of token ends, and the A and the B token that owns each."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of A and of B tokens up to each group's end, and the linked tokens: (upto_a, upto_b, link_a, link_b).

    Both arrays end at the same byte.
    """
    ends, own_a, own_b = intervals(ends_a, ends_b)
    shared = (ends_a[own_a] == ends) & (ends_b[own_b] == ends)
    ends, first_a, first_b = ends[shared], own_a[shared], own_b[shared]
    upto_a, upto_b = np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right")
    # Products: every A token that ends there with every B token that ends there.
    wide_a, wide_b = upto_a - first_a, upto_b - first_b
    of = np.repeat(np.arange(len(ends)), wide_a * wide_b)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(wide_a * wide_b) - wide_a * wide_b, wide_a * wide_b)
    return upto_a, upto_b, first_a[of] + nth // wide_b[of], first_b[of] + nth % wide_b[of]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> pd.DataFrame:
    """(start, end, a, b): the elementary intervals with the positions of the tokens that own them."""
    ends, own_a, own_b = intervals(ends_a, ends_b)
    return pd.DataFrame({"start": np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, "end": ends, "a": own_a, "b": own_b})


def written_groups(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3;`: the groups, each ended by a semicolon."""
    of_a, of_b = (np.repeat(np.arange(len(u)), np.diff(u, prepend=0)) for u in (upto_a, upto_b))
    mark_a, mark_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    mark_a[upto_a - 1], mark_b[upto_b - 1] = 1, 2
    order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
    return b"".join(np.concatenate([a.names[mark_a, ids_a], b.names[mark_b, ids_b]])[order].tolist())


def _ragged(word: str) -> bool:
    """White space stands at one of its ends, or it is empty."""
    return not word or word[0].isspace() or word[-1].isspace()


class Words:
    """Words aligned so far: tokens of either side and groups of each, its groups as written, and its linked pairs of ids."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, links; -1 where the bytes don't come back
        self.texts: list[bytes] = []
        self.pairs: list[bytes] = []  # longs

    def add(self, words: list[str]) -> None:
        """Aligns all words at once: as each ends with a shared end, they can stand behind one another."""
        words = sorted(words, key=_ragged)
        raw = [b" " + w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        ids, good = self._joined(words, raw, ends)
        if ids is None:
            ids, good = self._each(words, raw)
            ends = np.cumsum([len(r) if ok else 0 for r, ok in zip(raw, good)])
        of_a, of_b = np.cumsum(self.a.lengths[ids[0]]), np.cumsum(self.b.lengths[ids[1]])
        upto_a, upto_b, link_a, link_b = groups(of_a, of_b)
        upto = [np.searchsorted(of, ends, "right") for of in (of_a, of_b)]  # tokens of either side up to each word's end
        upto += [np.searchsorted(upto_a, upto[0], "right"), np.searchsorted(link_a, upto[0])]  # groups and links
        sizes = np.diff(np.stack(upto, axis=1), axis=0, prepend=0)
        sizes[~good] = -1
        written = written_groups(self.a, self.b, *ids, upto_a, upto_b).split(b";")[:-1]
        pairs = (ids[0][link_a] * WIDE + ids[1][link_b]).tobytes()
        self.known.update(zip(words, range(len(self.texts), len(self.texts) + len(words))))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.texts += [b";".join(written[x:y]) for x, y in zip([0, *upto[2].tolist()], upto[2].tolist())]
        self.pairs += [pairs[8 * x : 8 * y] for x, y in zip([0, *upto[3].tolist()], upto[3].tolist())]

    def _joined(self, words: list[str], raw: list[bytes], ends: np.ndarray) -> tuple[list[np.ndarray] | None, np.ndarray | None]:
        """Ids of either side, words without white space at their ends encoded in one text; None if the bytes don't come back."""
        n = sum(not _ragged(w) for w in words)
        texts = [" ".join(words[:n])] * (n > 0) + words[n:]
        whole, out = b"".join(raw), []
        for side in (self.a, self.b):
            ids = [k for x in side.encode(texts) for k in x]
            if b"".join([side.entries[k] for k in ids]) != whole:
                return None, None
            out.append(np.array(ids, dtype=np.int64))
            of = np.cumsum(side.lengths[out[-1]])
            if (of[np.searchsorted(of, ends)] != ends).any():
                return None, None
        return out, np.ones(len(words), dtype=bool)

    def _each(self, words: list[str], raw: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The same word by word; those that don't come back get no ids."""
        coded = [side.encode(words) for side in (self.a, self.b)]
        good = [all(b"".join([side.entries[k] for k in ids]) == r for side, ids in zip((self.a, self.b), both)) for r, *both in zip(raw, *coded)]
        return [np.array([k for x, ok in zip(ids, good) if ok for k in x], dtype=np.int64) for ids in coded], np.array(good, dtype=bool)

    def forget(self) -> None:
        """Keeps within the bounds."""
        for w in self.fresh:
            if len(w) > LONGEST:
                k = self.known.pop(w)
                self.texts[k] = self.pairs[k] = b""
        if len(self.texts) > REMEMBERED:
            self.clear()

    def of(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        self.fresh = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.known]
        if self.fresh:
            self.add(self.fresh)
        for words in texts:
            at = np.fromiter((self.known[w] for w in words), dtype=np.int64, count=len(words))
            n = self.sizes[at].sum(0) if len(at) else np.zeros(4, dtype=np.int64)
            if not len(at) or (self.sizes[at, 0] < 0).any():
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            places = at.tolist()
            sha = hashlib.sha256(b";".join([self.texts[k] for k in places])).hexdigest()
            pairs, times = np.unique(np.frombuffer(b"".join([self.pairs[k] for k in places]), dtype=np.int64), return_counts=True)
            yield *n.tolist(), sha, pairs, times
        self.forget()


def align(words: Words, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """For each text (n_a, n_b, n_groups, n_links, groups_sha256, different linked pairs, their numbers of links)."""
    run, n = [], 0
    for t in texts:
        run.append(words_of(t) if t else [])
        n += len(t)
        if n >= TOGETHER:
            yield from words.of(run)
            run, n = [], 0
    yield from words.of(run)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of_files: tuple[bytes, bytes] | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; pairs: its different linked id pairs."""
    shipped = docs.sparkSession.sparkContext.broadcast(of_files or files())

    @F.pandas_udf("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = sides(shipped.value)
        words = _words[id(both)] = _words.get(id(both)) or Words(*both)  # a worker's tasks share what it remembers
        for texts in batches:
            yield pd.DataFrame(align(words, list(texts)), columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_col).alias("_id"), of(text_of(text_col)).alias("_x")).select("_id", "_x.*")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): a pair of ids, its links in the corpus, whether no pair of its B id has more."""
    links = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("count"))
    links = links.withColumn("b", F.col("pair") % WIDE)
    top = links.groupBy("b").agg(F.max("count").alias("top"))
    return links.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def link_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of_files: tuple[bytes, bytes] | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    of_files = of_files or files()
    # A number tells rows of one id apart.
    rows = written(aligned(docs, id_col, text_col, of_files).withColumn("_at", F.monotonically_increasing_id()), "aligned")
    counts = bounded(written(pair_counts(rows), "pair-counts"), most_pairs(*sides(of_files)))
    own = ["_at", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    # The pairs of a row are read, looked up and added up again in one task.
    links = rows.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("l"))
    scored = links.join(counts, F.col("l.pairs") == F.col("pair"), "left")
    times = lambda of: F.coalesce(F.sum(of), F.lit(0))
    out = scored.groupBy(*own).agg(times(F.when(F.col("best"), F.col("l.times"))).alias("n_best"), times(F.col("l.times") * F.col("count")).alias("count_sum"))
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
