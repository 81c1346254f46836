"""SentencePiece encoding and decoding that keeps offsets.

Normalisation follows the model's compiled character map: at each place the longest prefix found in the map's
double-array trie is replaced, and every byte written remembers the source byte it came from. Pairs of neighbouring
symbols then merge by score, highest and then leftmost first; what no piece covers falls back to bytes. The
alignment projects every piece to the original bytes it stands for.

Merges never cross a place whose two neighbours stand side by side in no piece. If no piece has a space mark after
another character, texts are cut into words; words are cut at all such places, and what a cut piece of text gives is
kept and used again in its task (two generations of ``CACHE`` words).

Defined results: a null or empty text gives the end id alone and decodes to nothing; invalid UTF-8 reads as
replacement characters, and spans then count the replaced text; ids, repeated rows and extra columns need nothing
special; an empty table gives no rows. Models other than BPE, and those with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_and_text, utf8

#: Words kept in each of two generations, the longest of them, and the longest that merge by a plain search.
MARK, CACHE, KEPT_CHARS, SHORT = "▁", 350_000, 64, 48


class Kept:
    """Packed ids of words in two generations: when one is full, it becomes the older one."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, word: str, ids: bytes) -> None:
        if len(word) <= KEPT_CHARS:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[word] = ids


class CharMap:
    """A compiled character map: the size of a double-array trie, its units, and replacements that end in zero."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
        self.texts = blob[4 + n :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest prefix at a place that the map knows, 0 if none, and its replacement."""
        units, best = self.units, (0, b"")
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return best


class Codec:
    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(blob)
        spec, kinds = m.normalizer_spec, [p.type for p in m.pieces]
        if m.trainer_spec.model_type != 2 or {4, 5} & set(kinds) or m.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only BPE models with marked spaces before words and without user-defined or unused pieces are read")
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces, self.kinds = [p.piece for p in m.pieces], kinds
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in m.pieces if p.type == 1}
        self.unk = kinds.index(2)
        self.unk_surface = m.trainer_spec.unk_surface
        self.eos = next(i for i, p in enumerate(m.pieces) if p.type == 3 and p.piece == (m.trainer_spec.eos_piece or "</s>"))
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.widths = np.array([1 if k == 6 else len(p.encode()) if k == 1 else 0 for p, k in zip(self.pieces, kinds, strict=True)])
        longer = [p for p in self.ids if len(p) > 1]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in longer)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.by_word else "(?s).+")
        self.pairs = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.decimals = [str(i) for i in range(len(self.pieces))]
        # a byte below 128 is a character wherever it stands; others need their neighbours
        self.surfaces = [chr(self.bytes_of[i]) if self.bytes_of.get(i, 128) < 128 else "" if k == 3 else self.unk_surface if i == self.unk else p.replace(MARK, " ") for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True))]
        self.part_of_char = {i for i, b in self.bytes_of.items() if b >= 128}
        self.spaced, self.bare = Kept(), Kept()  # words after a space mark, without it, and other text

    # normalisation

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        mark = MARK.encode()
        if self.map is None and not self.squeeze:
            src = np.frombuffer(raw, np.uint8)
            where = np.repeat(np.arange(len(raw)), np.where(src == 32, len(mark), 1))
            head = mark if self.dummy else b""
            return head + raw.replace(b" ", mark), np.concatenate([np.zeros(len(head), np.int64), where, [len(raw)]])
        out, where, at, after_space = bytearray(), [], 0, self.squeeze

        def step(i: int) -> tuple[int, bytes]:
            b = raw[i]
            n, new = self.map.longest(raw, i) if self.map else (0, b"")
            if not n:
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                new = raw[i : i + n]
            return n, new

        if self.squeeze:
            while at < len(raw) and (got := step(at))[1] == b" ":
                at += got[0]
            if at == len(raw):
                return b"", np.array([at])
        if self.dummy:
            out += mark
            where += [at] * len(mark)
        while at < len(raw):
            n, new = step(at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put = new.replace(b" ", mark)
                out += put
                where += [at] * len(put)
                after_space = new.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], where[-len(mark) :]
        return bytes(out), np.array([*where, len(raw) if not where or not self.squeeze else at], np.int64)

    # merging

    def merge(self, text: str) -> list[str]:
        """Symbols after all merges."""
        return self._merge_short(text) if len(text) <= SHORT else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        cost, parts, none = self.cost.get, list(text), float("inf")
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (c := self.cost.get(both := parts[i] + parts[j])) is not None:
                heap.append((c, i, both)) if fresh else heapq.heappush(heap, (c, i, both))

        fresh = True
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        fresh = False
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _word(self, word: str) -> bytes:
        """Packed ids of a stretch of normalised text."""
        parts = self.merge(word)
        ids = [*map(self.ids.get, parts)]
        if None not in ids:
            return array("i", ids).tobytes()
        out: list[int] = []
        for p, k in zip(parts, ids, strict=True):
            if k is not None:
                out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return array("i", out).tobytes()

    def _find(self, word: str) -> bytes:
        """The same through what is kept; a word is cut where no piece has the two characters side by side."""
        kept, key = (self.spaced, word[1:]) if word[0] == MARK else (self.bare, word)
        got = kept.new.get(key)
        if got is None:
            got = kept.old.get(key)
            if got is None:
                pairs = self.pairs
                cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
                got = b"".join([self._find(word[i:j]) for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]) if cuts else self._word(word)
            kept.put(key, got)
        return got

    def encode(self, raw: bytes) -> tuple[np.ndarray, str, str]:
        """Ids without an end id, the same as decimals, and what they decode to."""
        if not raw:
            return np.zeros(0, "<i4"), "", ""
        norm = self.normalize(raw)[0].decode()
        if self.by_word and MARK + MARK not in norm and norm[0] == MARK and norm[-1] != MARK:
            words = norm[1:].split(MARK)
            found = [*map(self.spaced.new.get, words)]
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = self._find(MARK + words[i])
        else:
            found = [self._find(w) for w in self.words.findall(norm)]
        ids = np.frombuffer(b"".join(found), "<i4")
        listed = ids.tolist()
        return ids, " ".join([self.decimals[k] for k in listed]), self.decode(listed)

    # decoding and offsets

    def _surface(self, ids: list[int]) -> str:
        if self.part_of_char.isdisjoint(ids):
            return "".join([self.surfaces[k] for k in ids])
        out, run = [], bytearray()
        for k in [*ids, -1]:
            if k in self.bytes_of:
                run.append(self.bytes_of[k])
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if k >= 0 and self.kinds[k] != 3:
                out.append(self.unk_surface if k == self.unk else self.pieces[k].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the first space, which encoding adds, goes."""
        text = self._surface(ids)
        first = next((k for k in ids if self.kinds[k] != 3), None)
        if first is not None and self.pieces[first].startswith(MARK) and (self.dummy or self.squeeze):
            text = text.lstrip(" ") if self.squeeze else text[1:]
        return text

    def spans(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the first and last original byte, end exclusive; a mark that encoding added is empty."""
        _, where = self.normalize(raw)
        ends = np.cumsum(self.widths[ids])
        return where[np.concatenate([[0], ends[:-1]])] if len(ids) else ends, where[ends]


def _lenient(raw: bytes) -> str:
    """UTF-8 with a replacement character for every byte that can't be read."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + _lenient(raw[e.start + 1 :])


def valid(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


_CODECS: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """One codec a Python worker and broadcast model."""
    blob = shared.value
    key = zlib.crc32(blob)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(blob)
    return _CODECS[key]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = "ids array<int>, starts array<long>, ends array<long>, decoded string"


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids with the end id, starts and ends (original bytes of each id), and the decoded text."""
    shared = _share(docs, model)

    @F.pandas_udf(ENCODED)
    def each(texts: pd.Series) -> pd.DataFrame:
        codec, out = codec_of(shared), []
        for x in texts:
            raw = valid(bytes(x))
            ids, _, decoded = codec.encode(raw)
            a, b = codec.spans(raw, ids)
            out.append((np.append(ids, codec.eos), np.append(a, len(raw)), np.append(b, len(raw)), decoded))
        return pd.DataFrame(out, columns=["ids", "starts", "ends", "decoded"])

    return id_and_text(docs).select("doc_id", each(utf8(F.col("text"))).alias("e")).select("doc_id", "e.*")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (starts, then ends, as 64-bit numbers).

    The digests of what ``encode`` gives, made where the ids are so that these need not leave the task.
    """
    shared = _share(docs, model)

    @F.pandas_udf(DIGEST)
    def each(texts: pd.Series) -> pd.DataFrame:
        codec, out = codec_of(shared), []
        for x in texts:
            raw = valid(bytes(x))
            ids, said, decoded = codec.encode(raw)
            a, b = codec.spans(raw, ids)
            said = f"{said} {codec.eos}" if said else str(codec.eos)
            crc = zlib.crc32(np.asarray(b, "<i8").tobytes(), zlib.crc32(np.asarray(a, "<i8").tobytes()))
            out.append((len(ids) + 1, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), crc))
        return pd.DataFrame(out, columns=[x.split()[0] for x in DIGEST.split(", ")])

    return id_and_text(docs).select("doc_id", each(utf8(F.col("text"))).alias("e")).select("doc_id", "e.*")


def _share(docs: DataFrame, model: str | None):
    """The model file, about half a megabyte, goes to the executors as a broadcast."""
    with open(model or model_path(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
