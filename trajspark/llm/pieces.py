"""SentencePiece encoding and decoding by vectorised merge rounds.

The vocabulary (a BPE model with byte fallback) is read from its file, whose path
is a parameter. Texts are split into segments (words) between characters
that no piece has side by side. The distinct segments of a batch are
encoded together: flat arrays of symbols, the smallest pair rank of each word by
``minimum.reduceat``, all its leftmost non-overlapping occurrences merged at once,
and compaction, until no pair remains. A round that would create a pair of equal or
better rank merges the leftmost occurrence alone, so the result is the greedy one.

Null and empty texts have no tokens and decode to the empty text. Long texts are
never cut. Rows are independent, so repeated rows, ties and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trajspark.llm import frames
from trajspark.llm.text import code_points, mix

SPACE = "▁"
NONE = np.int64(1) << 40
#: Distinct words that a worker remembers between batches.
CACHE_WORDS = 300_000


def gather(flat: np.ndarray, at: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``picks`` of the ragged array (flat, at), one after the other, and their offsets."""
    size = (at[1:] - at[:-1])[picks]
    out = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return flat[np.repeat(at[picks] - out[:-1], size) + np.arange(out[-1])], out


def hashes(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each segment of code points."""
    out = []
    # place inside the segment, so equal segments hash alike wherever they stand
    inner = np.arange(len(points)) - np.repeat(start, size)
    for seed in (np.uint64(1), np.uint64(0x9FB21C651E98DF25)):
        factor = mix(np.arange(int(size.max()), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + seed) | np.uint64(1)
        value = (points.astype(np.uint64) + seed) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(29)
        out.append(mix(np.add.reduceat(value * factor[inner], start) + size.astype(np.uint64)))
    return out[0], out[1]


def _grown(n: int, lengths: set[int]) -> list[int]:
    """Lengths of the pieces of a run of n equal characters when the leftmost possible pair always merges."""
    run, k = [1] * n, 0
    while k + 1 < len(run):
        if run[k] + run[k + 1] in lengths:
            run[k : k + 2] = [run[k] + run[k + 1]]
            k = 0
        else:
            k += 1
    return run


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.vocab_size()
        self.byte_id = np.full(256, -1, np.int64)
        self.unknown = sp.unk_id()
        pieces, plain = [sp.id_to_piece(i) for i in range(self.size)], {}
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.is_byte[i] = True
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                plain[p] = i
                self.surface.append(p.replace(SPACE, " ").encode())
        score = {p: sp.get_score(i) for p, i in plain.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.zeros(self.size, np.int64)
        for p, i in plain.items():
            self.rank[i] = order[score[p]]
        self.char_id = {p: i for p, i in plain.items() if len(p) == 1}
        keys, made = [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in plain and p[k:] in plain:
                    keys.append(plain[p[:k]] * self.size + plain[p[k:]])
                    made.append(i)
        by = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[by], np.array(made, np.int64)[by]
        known = {c for p in plain for c in p}
        #: Runs of spaces merge after everything else, from the left: their tokens follow from their length.
        lengths = {len(p) for p in plain if set(p) == {SPACE}}
        lowest = min(score.values())
        if any(score[SPACE * n] != lowest for n in lengths) or sum(x == lowest for x in score.values()) != len(lengths):
            raise ValueError("runs of spaces must be the last merges of the vocabulary")
        self.run = max(lengths)
        self.space_runs = [[plain[SPACE * k] for k in _grown(n, lengths)] for n in range(self.run + 1)]
        if any(_grown(self.run + n, lengths) != [self.run, *_grown(n, lengths)] for n in range(self.run + 1)):
            raise ValueError("runs of spaces don't split at their longest piece")
        if any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{{2,}}[^{SPACE}]", p) for p in plain):
            raise ValueError("a piece reaches across the start of a word")
        if any(c not in self.char_id for c in known):
            raise ValueError("a character of a piece is no piece")
        letters = sorted(known)
        number = {c: k for k, c in enumerate(letters, 1)}
        #: Number of each character that occurs in pieces, else 0, and the pairs that occur side by side in a piece.
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in plain:
            for x, y in zip(p, p[1:]):
                self.beside[number[x], number[y]] = True
        self.single = np.full(len(letters) + 1, -1, np.int64)
        self.single[1:] = [self.char_id[c] for c in letters]
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in self.surface])]).astype(np.int64)
        self.surface_flat = np.frombuffer(b"".join(self.surface), np.uint8)
        digits = [b"%d," % i for i in range(self.size)]
        self.digits_at = np.concatenate([[0], np.cumsum([len(s) for s in digits])]).astype(np.int64)
        self.digits_flat = np.frombuffer(b"".join(digits), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Cached segments: sorted hashes, second hashes, places, and their tokens as a ragged array."""
        self.hash, self.check, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of neighbours; rank NONE where they make no piece."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], -1)
        return np.where(piece >= 0, self.rank[piece], NONE), piece

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all words at once; ``symbols`` are piece ids, or -1 - code point, in order of ``word``."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            n = len(symbols)
            rank, piece = np.full(n, NONE), np.full(n, -1, np.int64)
            same = word[:-1] == word[1:]
            rank[:-1][same], piece[:-1][same] = self.pair(symbols[:-1][same], symbols[1:][same])
            while True:
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                best = np.minimum.reduceat(rank, first)
                size = np.diff(np.append(first, len(symbols)))
                open_ = best < NONE
                if not open_.all():  # compaction: words without a pair leave
                    gone = np.repeat(~open_, size)
                    done.append((symbols[gone], word[gone]))
                    symbols, word, rank, piece = (x[~gone] for x in (symbols, word, rank, piece))
                    if not len(symbols):
                        break
                    best, size = best[open_], size[open_]
                    first = np.concatenate([[0], np.cumsum(size)[:-1]])
                hit = rank == np.repeat(best, size)
                at = np.flatnonzero(hit)
                run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                take = at[place % 2 == 0]
                new = symbols.copy()
                new[take] = piece[take]
                keep = np.ones(len(symbols), bool)
                keep[take + 1] = False
                worse = self._risky(new, keep, take, word, best, first, size)
                if len(worse):  # words where a new pair would come first: one merge only
                    lone = np.isin(np.searchsorted(first, take, "right") - 1, worse)
                    w_of = np.searchsorted(first, take[lone], "right") - 1
                    later = np.concatenate([[False], w_of[1:] == w_of[:-1]])
                    undo = take[lone][later]
                    keep[undo + 1] = True
                    new[undo] = symbols[undo]
                    take = np.setdiff1d(take, undo, assume_unique=True)
                touched = np.zeros(len(symbols), bool)
                touched[take] = True
                symbols, word, rank, piece, touched = (x[keep] for x in (new, word, rank, piece, touched))
                fix = np.flatnonzero(touched)
                fix = np.unique(np.concatenate([fix, fix[fix > 0] - 1]))
                inner = fix[fix < len(symbols) - 1]
                rank[fix], piece[fix] = NONE, -1
                inner = inner[word[inner] == word[inner + 1]]
                rank[inner], piece[inner] = self.pair(symbols[inner], symbols[inner + 1])
        if not done:
            return symbols, word
        symbols, word = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _risky(self, new, keep, take, word, best, first, size) -> np.ndarray:
        """Words (places in ``first``) in which this round makes a pair of equal or better rank."""
        symbols, places = new[keep], np.flatnonzero(keep)
        mark = np.zeros(len(new), bool)
        mark[take] = True
        mark = mark[keep]
        side = np.flatnonzero((mark[:-1] | mark[1:]) & (word[places[:-1]] == word[places[1:]]))
        of = np.searchsorted(first, places[side], "right") - 1
        rank, _ = self.pair(symbols[side], symbols[side + 1])
        return np.unique(of[rank <= best[of]])

    def tokens(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the segments ``points[start : start + size]``, ragged."""
        space, n = self.char_id[SPACE], len(start)
        at = np.concatenate([[0], np.cumsum(size)])
        chars = points[np.repeat(start - at[:-1], size) + np.arange(at[-1])].astype(np.int64)
        word = np.repeat(np.arange(n), size)
        # leading spaces but the last are left out; they merge after everything else
        other = np.where(chars != ord(SPACE), np.arange(len(chars)), len(chars))
        lead = np.minimum(np.minimum.reduceat(other, at[:-1]) - at[:-1], size) if n else size
        inner = np.arange(len(chars)) - np.repeat(at[:-1], size) >= np.repeat(np.maximum(lead - 1, 0), size)
        chars, word = chars[inner], word[inner]
        ids = self.single[self.number[chars]]
        symbols, word = self.merge(np.where(ids < 0, -1 - chars, ids), word)
        odd = np.flatnonzero(symbols < 0)
        if len(odd):  # byte fallback
            enc = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in symbols[odd]]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(e) for e in enc]
            word, symbols = np.repeat(word, times), np.repeat(symbols, times)
            symbols[symbols < 0] = self.byte_id[np.frombuffer(b"".join(enc), np.uint8)]
        many = np.flatnonzero(lead > 1)
        if len(many):
            cut = np.searchsorted(word, many)
            bare = symbols[cut] == space
            runs = []
            for k, b in zip(many, bare):
                more = int(lead[k]) - (not b)
                runs.append(self.space_runs[self.run] * (more // self.run) + self.space_runs[more % self.run])
            sizes = [len(r) for r in runs]
            keep = np.ones(len(symbols), bool)
            keep[cut[bare]] = False
            before = np.concatenate([[0], np.cumsum(keep)])[cut]
            where = np.repeat(before, sizes)
            symbols = np.insert(symbols[keep], where, np.concatenate([np.array(r, np.int64) for r in runs]))
            word = np.insert(word[keep], where, np.repeat(many, sizes))
        return symbols.astype(np.int32), np.searchsorted(word, np.arange(n + 1))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and the offsets of each text."""
        ready = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in ready])]).astype(np.int64)
        points = code_points("".join(ready))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = self.number[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.beside[kind[:-1], kind[1:]]
        cut[bounds] = True
        edge = np.flatnonzero(cut)
        start, size = edge[:-1], np.diff(edge)
        h, check = hashes(points, start, size)
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.hash, key), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != key) if len(self.hash) else np.arange(len(key))
        if len(new):
            flat, to = self.tokens(points, start[first[new]], size[first[new]])
            places = np.arange(len(new)) + len(self.at) - 1
            self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, to[1:] + self.at[-1]])
            all_hash = np.concatenate([self.hash, key[new]])
            order = np.argsort(all_hash, kind="stable")
            self.hash = all_hash[order]
            self.check = np.concatenate([self.check, check[first[new]]])[order]
            self.place = np.concatenate([self.place, places])[order]
            at = np.searchsorted(self.hash, key)
        at = at[back]
        flat, to, picks = self.flat, self.at, self.place[at]
        clash = np.flatnonzero(self.check[at] != check)
        if len(clash):  # equal first hash of different segments: these are encoded apart
            more, more_at = self.tokens(points, start[clash], size[clash])
            picks = picks.copy()
            picks[clash] = np.arange(len(clash)) + len(to) - 1
            flat, to = np.concatenate([flat, more]), np.concatenate([to, more_at[1:] + to[-1]])
        ids, out = gather(flat, to, picks)
        return ids, out[np.searchsorted(start, bounds)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of token ids: pieces joined, bytes read as UTF-8, the leading space of the first piece dropped."""
        raw, to = gather(self.surface_flat, self.surface_at, ids.astype(np.int64))
        data, out = raw.tobytes(), []
        for a, b in zip(at[:-1], at[1:]):
            part, lo = data[to[a] : to[b]], a
            while lo < b and self.surface_at[ids[lo]] == self.surface_at[ids[lo] + 1]:
                lo += 1  # control ids have no text
            if lo < b and not self.is_byte[ids[lo]] and part[:1] == b" ":
                part = part[1:]
            out.append(readable(part))
        return out


def readable(raw: bytes) -> str:
    """UTF-8 as text; each byte that is no part of a valid character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per worker and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _encoded(texts: pa.Array, model: bytes, step: int = 256):
    c = codec(model)
    for a in range(0, len(texts), step):
        part = texts.slice(a, step).to_pylist()
        yield c, part, *c.encode(part)


def encode(docs: DataFrame, model: bytes, name: str = "tokens", text: str = "text") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())) for _, _, ids, at in _encoded(batch.column(text), shared.value)]
        return [pa.concat_arrays(got) if got else pa.array([], pa.list_(pa.int32()))]

    return frames.appended(docs, [T.StructField(frames.fresh(docs, name), T.ArrayType(T.IntegerType()))], run, text)


def decode(tokens: DataFrame, model: bytes, name: str = "decoded", column: str = "tokens") -> DataFrame:
    """``tokens`` with the text of each list of ids (null: empty)."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[str] = []
        for a in range(0, batch.num_rows, 256):
            lists = batch.column(column).slice(a, 256)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out += codec(shared.value).decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        return [pa.array(out, pa.string())]

    return frames.appended(tokens, [T.StructField(frames.fresh(tokens, name), T.StringType())], run, by=None)


def round_trip(docs: DataFrame, model: bytes, text: str = "text", names: tuple[str, str] = ("tokens", "decoded")) -> DataFrame:
    """``docs`` with the token ids of each whole text and the text that they decode to, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, texts = [pa.array([], pa.list_(pa.int32()))], []
        for c, _, flat, at in _encoded(batch.column(text), shared.value):
            ids.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())))
            texts += c.decode(flat, at)
        return [pa.concat_arrays(ids), pa.array(texts, pa.string())]

    kinds = T.ArrayType(T.IntegerType()), T.StringType()
    return frames.appended(docs, [T.StructField(frames.fresh(docs, n), k) for n, k in zip(names, kinds)], run, text)


def digests(docs: DataFrame, model: bytes, text: str = "text", names: tuple[str, str, str] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """``docs`` with the number of tokens and SHA-256 of the joined ids and of the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n, a, b = [], [], []
        for c, part, ids, at in _encoded(batch.column(text), shared.value):
            raw, to = gather(c.digits_flat, c.digits_at, ids.astype(np.int64))
            raw = raw.tobytes()
            n += np.diff(at).tolist()
            a += [hashlib.sha256(raw[to[x] : max(to[x], to[y] - 1)]).hexdigest() for x, y in zip(at[:-1], at[1:])]
            b += [hashlib.sha256(t.encode()).hexdigest() for t in c.decode(ids, at)]
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    kinds = T.LongType(), T.StringType(), T.StringType()
    return frames.appended(docs, [T.StructField(frames.fresh(docs, x), k) for x, k in zip(names, kinds)], run, text)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, model_bytes()).drop("text")
