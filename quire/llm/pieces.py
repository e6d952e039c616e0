"""SentencePiece encoding and decoding with byte offsets into the original text.

The normaliser walks the text by the longest prefix found in the model's compiled character map (a double-array trie) and records
for every normalised character the original bytes it stands for. Byte-pair merging then runs inside chunks that no piece of the
vocabulary can cross (a run of word marks and what follows it), so each distinct chunk of a task is merged once. Every piece is
projected back through the recorded alignment to a span of original bytes.

Tokens agree with the sentencepiece library (tests compare ids, offsets and decoded texts). Where the model's normaliser changes
nothing, the distinct chunks of a batch are merged by the library in one call, which is ten times as fast as the loop here; models
with a character map, with user pieces or squeezed spaces are merged here.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the model format: kinds of pieces, and the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


class CharMap:
    """Longest-prefix replacement through a compiled character map: 4 bytes of trie size, the trie units, the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key at a place, or None."""
        units = self.units
        if not units:
            return None
        found, node = None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start:self.texts.index(b"\0", start)])
        return found


class Pieces:
    """One model file: normalise, merge, project, decode."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type != m.trainer_spec.BPE:
            raise ValueError("only BPE models are supported")
        norm = m.normalizer_spec
        self.map = CharMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        if m.trainer_spec.treat_whitespace_as_suffix or not self.escape:
            raise ValueError("models with suffix marks or plain spaces are not supported")
        self.names = [p.piece for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        self.unk = self.kinds.index(UNKNOWN)
        self.unk_text = m.trainer_spec.unk_surface
        self.ranks = {p.piece: (-p.score, i) for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.bytes = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE} if m.trainer_spec.byte_fallback else {}
        users = sorted((n for n, k in zip(self.names, self.kinds) if k == USER), key=lambda n: (-len(n), n))
        self.users = re.compile("|".join(map(re.escape, users))) if users else None
        if any(k == UNUSED for k in self.kinds):
            raise ValueError("models with unused pieces are not supported")
        self.whole = not any(MARK in n.lstrip(MARK) for n in self.ranks) and not users
        self.bulk = None
        if self.whole and self.dummy and not self.squeeze and not self.map.units:
            from sentencepiece import SentencePieceProcessor

            self.bulk = SentencePieceProcessor(model_proto=model)
        self.surface = [self._surface(n, k) for n, k in zip(self.names, self.kinds)]
        self.plain = [chr(s) if type(s) is int and s < 128 else None if type(s) is int else s for s in self.surface]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _surface(self, name: str, kind: int):
        if kind == BYTE:
            return int(name[1:-1], 16)
        return "" if kind == CONTROL else self.unk_text if kind == UNKNOWN else name.replace(MARK, " ")

    # normalisation

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, per normalised character plus one, its first original byte (None: characters stand for themselves)."""
        if not self.map.units and not self.squeeze and not self.users:
            return ((MARK if self.dummy and text else "") + text.replace(" ", MARK)), None
        data = text.encode("utf-8")
        out: list[str] = []
        places: list[int] = []
        at, n = 0, len(data)

        def step(at: int) -> tuple[int, str, bool]:
            if self.users and (m := self.users.match(data[at:at + 512].decode("utf-8", "ignore"))):
                return len(m[0].encode("utf-8")), m[0], True
            hit = self.map.longest(data, at)
            if hit:
                return hit[0], hit[1].decode("utf-8"), False
            c = data[at]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            return width, data[at:at + width].decode("utf-8"), False

        if self.squeeze:
            while at < n:
                used, new, fixed = step(at)
                if new != " " or fixed:
                    break
                at += used
        if self.dummy and at < n:
            out.append(MARK)
            places.append(at)
        spaced = self.squeeze
        while at < n:
            used, new, fixed = step(at)
            if spaced and not fixed:
                new = new.lstrip(" ")
            if new:
                for c in new:
                    out.append(MARK if c == " " else c)
                    places.append(at)
                spaced = self.squeeze and not fixed and new.endswith(" ")
            at += used
        end = n
        if self.squeeze:
            while out and out[-1] == MARK:
                end = places.pop()
                out.pop()
        places.append(end)
        return "".join(out), places

    # merging

    def _merge(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk: the best-scored adjacent pair is merged first, of equal ones the leftmost."""
        if self.users:
            parts, last = [], 0
            for m in self.users.finditer(chunk):
                parts += [*chunk[last:m.start()], m[0]]
                last = m.end()
            parts += chunk[last:]
            frozen = [len(p) > 1 or bool(self.users.fullmatch(p)) for p in parts]
        else:
            parts, frozen = list(chunk), []
        ranks, none = self.ranks, (1e300, -1)
        # rank of each part joined with its right neighbour; the first smallest is the next merge
        pair = [ranks.get(a + b, none)[0] for a, b in zip(parts, parts[1:])]
        if frozen:
            pair = [1e300 if frozen[i] or frozen[i + 1] else r for i, r in enumerate(pair)]
        if len(parts) > 64:
            return self._ids_of(self._merge_long(parts, pair, frozen))
        while pair:
            best = min(pair)
            if best == 1e300:
                break
            i = pair.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if frozen:
                del frozen[i + 1]
            if i:
                pair[i - 1] = 1e300 if frozen and frozen[i - 1] else ranks.get(parts[i - 1] + parts[i], none)[0]
            if i < len(pair):
                pair[i] = 1e300 if frozen and frozen[i + 1] else ranks.get(parts[i] + parts[i + 1], none)[0]
        return self._ids_of(parts)

    def _merge_long(self, parts: list[str], pair: list[float], frozen: list[bool]) -> list[str]:
        """The same merges with a heap over linked parts, for chunks that a scan per merge would be slow on."""
        ranks, n = self.ranks, len(parts)
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 1, parts[i] + parts[i + 1]) for i, r in enumerate(pair) if r != 1e300]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and not (frozen and (frozen[i] or frozen[j])) and (new := parts[i] + parts[j]) in ranks:
                heapq.heappush(heap, (ranks[new][0], i, j, new))

        while heap:
            _, i, j, new = heapq.heappop(heap)
            if not live[i] or right[i] != j or not live[j] or parts[i] + parts[j] != new:
                continue
            parts[i], live[j] = new, False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p, alive in zip(parts, live) if alive]

    def _ids_of(self, parts: list[str]) -> tuple[int, ...]:
        ranks = self.ranks
        ids: list[int] = []
        for p in parts:
            if p in ranks:
                ids.append(ranks[p][1])
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode("utf-8")]
            else:
                ids.append(self.unk)
        if not self.bytes:  # neighbouring unknown pieces are one
            ids = [x for k, x in enumerate(ids) if x != self.unk or not k or ids[k - 1] != self.unk]
        return tuple(ids)

    def ids(self, text: str, normalised: str | None = None) -> list[int]:
        """Token ids of a whole text."""
        body = self.normalise(text)[0] if normalised is None else normalised
        if not self.whole or not self.bytes:
            return list(self._merge(body))
        chunks = CHUNKS.findall(body)
        cache = self.cache
        if len(cache) > 400_000:  # bounds memory; the chunks are merged again when they come again
            cache.clear()
        new = list(set(chunks).difference(cache))
        if self.bulk:
            # the library puts the first mark itself; a chunk of marks alone would be empty to it
            ready = [c for c in new if c[0] == MARK and c[-1] != MARK]
            cache.update(zip(ready, map(tuple, self.bulk.encode([c[1:].replace(MARK, " ") for c in ready], num_threads=1))))
            new = [c for c in new if c[0] != MARK or c[-1] == MARK]
        for chunk in new:
            cache[chunk] = self._merge(chunk)
        return list(chain.from_iterable(map(cache.__getitem__, chunks)))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, byte after) of every token in the original text. """
        body, places = self.normalise(text)
        if places is None:
            places, at = [], 0
            if self.dummy and text:
                places.append(0)
            for c in text:
                places.append(at)
                at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
            places.append(at)
        out, c, pending = [], 0, 0
        for i in self.ids(text, body):
            if self.kinds[i] == BYTE:
                # the bytes of one character share its span: the last of them holds it, those before are empty
                pending = pending or len(body[c].encode("utf-8"))
                pending -= 1
                out.append((i, places[c], places[c] if pending else places[c + 1]))
                c += not pending
            else:
                n = len(self.names[i]) if self.kinds[i] != UNKNOWN else self._unknown(body, c)
                out.append((i, places[c], places[c + n]))
                c += n
        return out

    def _unknown(self, body: str, c: int) -> int:
        n = 1
        while c + n < len(body) and body[c + n] not in self.ranks:
            n += 1
        return n

    # decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the space the normaliser put first is taken off, runs of bytes are read as UTF-8.

        Bytes that form no valid character become U+FFFD one by one.
        """
        if not self.squeeze and ids and self.kinds[ids[0]] == NORMAL:
            try:
                text = "".join(map(self.plain.__getitem__, ids))
                return text[1:] if self.dummy and text[:1] == " " else text
            except TypeError:
                pass  # bytes beyond ASCII need their neighbours
        surface, out, run = self.surface, [], bytearray()
        first = True
        for i in ids:
            s = surface[i]
            if type(s) is int:
                run.append(s)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
                first = False
            if first and self.kinds[i] != CONTROL:
                if self.dummy and s[:1] == " " and self.kinds[i] != UNKNOWN:
                    s = s[1:] if not self.squeeze else s.lstrip(" ")
                first = False
            out.append(s)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)


CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _utf8(run: bytes) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for width in (1, 2, 3, 4):
                try:
                    out.append(run[at:at + width].decode("utf-8"))
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _batches(blob: bytes, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(blob)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [model.spans(t.as_py() or "") if spans else model.ids(t.as_py() or "") for t in texts.slice(at, 256)]
                ids = [[x[0] for x in r] for r in rows] if spans else rows
                columns = [*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))]
                if spans:
                    columns += [pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int32())) for k in (1, 2)]
                names = [*part.schema.names[:-1], "ids", *(["begins", "ends"] if spans else [])]
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _digests(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(blob)
        for batch in batches:
            counts, heads, backs = [], [], []
            for t in batch.column(batch.num_columns - 1):
                ids = model.ids(t.as_py() or "")
                counts.append(len(ids))
                heads.append(hashlib.sha256(",".join(map(model.numbers.__getitem__, ids)).encode()).hexdigest())
                backs.append(hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(heads), pa.array(backs)],
                                             [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _prepared(docs: DataFrame, text: str, own: list[str]) -> tuple[DataFrame, str]:
    kept = [c for c in docs.columns if c not in own and c != text]
    df = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return df, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])


def encode(docs: DataFrame, model: str, text: str = "text", spans: bool = True) -> DataFrame:
    """Adds ids (and begins, ends: original byte spans) to every row; the text column goes, columns named like the results too.

    ``model`` is the path of the model file on the driver; its bytes (under 1 MB) travel with the tasks. NULL counts as empty and
    gives no ids; repeated rows stay; order within a text is kept. Memory is bounded by 256 rows or the longest text.
    """
    df, schema = _prepared(docs, text, ["ids", "begins", "ends"])
    with open(model, "rb") as f:
        blob = f.read()
    extra = ", begins array<int>, ends array<int>" if spans else ""
    return df.mapInArrow(_batches(blob, spans), f"{schema}{', ' if schema else ''}ids array<int>{extra}")


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Encode whole texts and decode their ids again: n_tokens, ids_sha256, decoded_sha256 beside the other columns."""
    df, schema = _prepared(docs, text, ["n_tokens", "ids_sha256", "decoded_sha256"])
    with open(model, "rb") as f:
        blob = f.read()
    return df.mapInArrow(_digests(blob), f"{schema}{', ' if schema else ''}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
