"""Alignment of the tokens of two tokenizers over the same bytes, and how often ids are linked.

Both tokenizers' tokens end at byte offsets; offsets where both end cut a text into groups. `runs` finds them by
skipping along diagonals: at the current shift between the two indexes the arrays of ends are
compared in stretches that double while they agree and halve once they don't, so a one-to-one stretch of n
tokens takes about log n comparisons; where the ends part, the smaller one moves on until they meet, and the
group found sets the next shift.

A partition's rows are taken in blocks of about `block_chars` bytes. A block holds its documents' distinct links and
gives each pair of ids that it links with the number of its documents; Spark sums those over all blocks, finds
the highest count of each id of the first tokenizer, and joins both back to the blocks that have the pair. Rows
shuffled are a block's distinct pairs and its documents' links, so all grows in proportion to the data.

Texts null, empty, or whose tokens' bytes differ from space + text (such as texts with U+2581) have no tokens: zeros and ''. Special
tokens' strings in a text are plain text. Very long texts are blocks of their own; a group of very many tokens on both sides
is taken by distinct ids. Repeated rows are documents of their own; an empty table gives no rows; only the columns named are read.
"""
from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Splitter, default_path, encoder, pieces_of
from .common import keep

#: A pair of ids as one int: the first tokenizer's id in the upper bits.
SHIFT = 15
#: Words whose tokens a task remembers; bytes of text aligned at once; links of a group that are made one by one.
WORDS, PIECE, MANY = 400_000, 1_000_000, 1_000_000
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Ids of space + text by both tokenizers, and every id's bytes. Words are encoded once and remembered.

    Neither tokenizer has a token that goes on over a space after another sign (checked for the second; the first's
    pattern forbids it unless white space meets), so a text is encoded word by word, a word being a space and what follows it.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if len(pieces) > 1 << SHIFT or any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has over {1 << SHIFT} pieces or pieces of several words")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a = pieces_of(path_a)
        self.space = [self.sp.piece_to_id("▁")]
        self.encode_a, self.split = encoder(path_a), Splitter([])
        self.spaced = re.compile(" +[^ ]*").findall
        #: word -> the ids' bytes of both tokenizers, and whether both say the word's own bytes.
        self.words: dict[str, tuple[bytes, bytes, bool]] = {}

    def coded(self, whole: str, pieces: list[str], words: list[str]) -> tuple[bytes, bytes, bool]:
        """Both tokenizers' ids of a text given as the first one's pieces and as spaces with what follows; the second adds a word's first space itself."""
        a = [i for w in pieces for i in self.encode_a(w)]
        b = [i for w in words for i in (self.sp.encode(w[1:]) if len(w) > 1 else self.space)]
        said = whole.encode()
        fine = b"".join([self.bytes_a[i] for i in a]) == said == b"".join([self.bytes_b[i] for i in b])
        return np.asarray(a, np.int32).tobytes(), np.asarray(b, np.int32).tobytes(), fine

    def learn(self, lists: list[list[str]]) -> None:
        """Encodes the words that no text had before, all of them at once."""
        every = set().union(*lists)
        if len(self.words) + len(every) > WORDS:
            self.words.clear()
        new = list(every - self.words.keys())
        a, b = list(map(self.encode_a, [" " + w for w in new])), self.sp.encode(new, num_threads=1)
        if "" in every:
            b = [ids or self.space for ids in b]
        whole = [(" " + w).encode() for w in new]
        parts, fine = [], np.ones(len(new), bool)
        for ids, piece in ((a, self.bytes_a), (b, self.bytes_b)):
            said = [b"".join(map(piece.__getitem__, x)) for x in ids]
            if said != whole:
                fine &= [x == y for x, y in zip(said, whole)]
            ends = [0, *np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * 4).tolist()]
            data = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1] // 4).tobytes()
            parts.append([data[x:y] for x, y in zip(ends, ends[1:])])
        self.words.update(zip(new, zip(*parts, fine.tolist())))

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text both lists of ids as int32, empty where there are no tokens."""
        # A text is encoded by words if white space never meets: the second tokenizer has tokens of several spaces.
        split = [t.split(" ") if t and "  " not in (whole := " " + t) and self.split.simple(whole) else None for t in texts]
        self.learn([x for x in split if x])
        out = []
        for text, words in zip(texts, split):
            if not text:
                out.append((b"", b""))
                continue
            if words:
                a, b, fine = zip(*map(self.words.__getitem__, words))
                if all(fine):
                    out.append((b"".join(a), b"".join(b)))
                    continue
            whole = " " + text
            a, b, fine = self.coded(whole, self.split.pieces(whole), self.spaced(whole))
            out.append((a, b) if fine else (b"", b""))
        return out


def runs(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in both arrays of ends, one past the last token of each group; both arrays rise and have the same last end."""
    la, lb, ba, bb = ea.tolist(), eb.tolist(), ea.astype(np.int64).tobytes(), eb.astype(np.int64).tobytes()
    n, m, i, j = len(la), len(lb), 0, 0
    at, to, length = [], [], []  # of each stretch: where its first group ends in both arrays, and how many groups follow one to one
    while i < n:
        if la[i] != lb[j]:  # an irregular group: the end that is behind moves on
            x, y = la[i], lb[j]
            while x != y:
                if x < y:
                    i += 1
                    x = la[i]
                else:
                    j += 1
                    y = lb[j]
        i, j = i + 1, j + 1
        at.append(i)
        to.append(j)
        k = 0
        if i < n and la[i] == lb[j]:
            k, step, growing, most = 1, 2, True, n - i if n - i < m - j else m - j
            while step and k < most:
                end = k + step if k + step < most else most
                if ba[8 * (i + k) : 8 * (i + end)] == bb[8 * (j + k) : 8 * (j + end)]:
                    k, step = end, 2 * step if growing else step // 2
                else:
                    growing, step = False, step // 2
            i, j = i + k, j + k
        length.append(k)
    counts = np.asarray(length, np.int64) + 1
    along = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.asarray(at, np.int64), counts) + along, np.repeat(np.asarray(to, np.int64), counts) + along


def links_of(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, pair, number) of the distinct links of each document, in order of doc and pair."""
    na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    few = na * nb <= MANY
    group = np.repeat(np.arange(len(ga)), na)  # of each token of a
    chosen = few[group]
    width = nb[group] * chosen
    first = np.cumsum(width) - width
    right = np.repeat((gb - nb)[group] - first, width) + np.arange(int(width.sum()))
    keys = [np.repeat(doc_of_group[group] << 31 | a.astype(np.int64) << SHIFT, width) | b[right]]
    weights: list[np.ndarray] = []
    for g in np.flatnonzero(~few).tolist():
        xs, xn = np.unique(a[ga[g] - na[g] : ga[g]], return_counts=True)
        ys, yn = np.unique(b[gb[g] - nb[g] : gb[g]], return_counts=True)
        keys.append((doc_of_group[g] << 31 | xs.astype(np.int64)[:, None] << SHIFT | ys[None, :]).ravel())
        weights.append((xn[:, None] * yn[None, :]).ravel())
    found, number = np.unique(keys[0], return_counts=True)
    if weights:
        found, where = np.unique(np.concatenate([found, *keys[1:]]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, np.concatenate([number, *weights]))
        number = total
    return found >> 31, (found & (1 << 31) - 1).astype(np.int32), number


class Aligner:
    """Aligns lists of texts; made once a task."""

    def __init__(self, path_a: str, path_b: str):
        self.tokens = t = Tokenizers(path_a, path_b)
        self.length_a, self.length_b = np.asarray([len(x) for x in t.bytes_a]), np.asarray([len(x) for x in t.bytes_b])
        n, m = len(t.bytes_a), len(t.bytes_b)
        #: What is written of a token: an id of either tokenizer within a group, then the last of a group.
        self.written = np.asarray([f"{i},".encode() for i in range(n)] + [f"{i}|".encode() for i in range(n)] + [f"{i},".encode() for i in range(m)] + [f"{i};".encode() for i in range(m)])

    def ids(self, texts: list[str | None]):
        """Flat ids of both, and where each text's end."""
        a, b = zip(*self.tokens.ids(texts))
        ends = np.zeros((len(texts) + 1, 2), np.int64)
        ends[1:, 0], ends[1:, 1] = np.cumsum([len(x) // 4 for x in a]), np.cumsum([len(x) // 4 for x in b])
        return np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32), ends

    def aligned(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, sha256) of each text, and `links_of` them all."""
        a, b, ends = self.ids(texts)
        if not len(a):
            return np.zeros((len(texts), 3), np.int64), [""] * len(texts), (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
        # Texts follow each other in both arrays of ends, and each text's end is an end in both.
        ga, gb = runs(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        doc = np.searchsorted(ends[:, 0], ga, side="left") - 1  # the text whose tokens the group ends
        na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ga - 1], last_b[gb - 1] = True, True
        n, m = len(self.tokens.bytes_a), len(self.tokens.bytes_b)
        order = np.empty(len(a) + len(b), np.int32)
        order[np.arange(len(a)) + np.repeat(gb - nb, na)] = a + n * last_a
        order[np.arange(len(b)) + np.repeat(ga, nb)] = 2 * n + b + m * last_b
        cuts = ends.sum(1).tolist()
        # Shorter numbers are filled up with zero bytes, which go again.
        digests = [hashlib.sha256(self.written[order[x:y]].tobytes().translate(None, b"\0")[:-1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:])]
        counts = np.column_stack([np.diff(ends, axis=0), np.bincount(doc, minlength=len(texts))])
        return counts, digests, links_of(a, b, ga, gb, doc)

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        a, b, _ = self.ids([text])
        if not len(a):
            return []
        ga, gb = runs(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        return list(zip((x.tolist() for x in np.split(a, ga[:-1])), (x.tolist() for x in np.split(b, gb[:-1]))))


def groups(df: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", into: str = "groups") -> DataFrame:
    """`df` with array<struct<a: array<int>, b: array<int>>> `into`: the ids of each group, in order. A column already named `into` is replaced."""
    path_a, path_b, df = path_a or default_path(), path_b or piece_path(), df.drop(into)
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(f"`{into}` array<struct<a: array<int>, b: array<int>>>")
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def task(batches):
        aligner = Aligner(path_a, path_b)
        for b in batches:
            yield b.append_column(into, pa.array([[{"a": x, "b": y} for x, y in aligner.groups(t)] for t in b.column(text).to_pylist()], kind))

    return df.mapInArrow(task, StructType([*df.schema.fields, *added.fields]))


def squeezed(at: np.ndarray, number: np.ndarray) -> bytes:
    """Rising places and their numbers as compressed bytes: gaps and numbers by bytes of equal weight."""
    both = np.concatenate([np.diff(at, prepend=0), number]).astype("<u4")
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(at) else b""


def opened(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T).view("<u4").ravel() if n else np.empty(0, "<u4")
    return np.cumsum(both[:n], dtype=np.int64), both[n:].astype(np.int64)


def linked(df: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text", block_chars: int = 16_000_000) -> DataFrame:
    """COLUMNS for every row: tokens, groups, links, links with the highest count of their first id, and the sum of counts over links."""
    path_a, path_b = path_a or default_path(), path_b or piece_path()

    def parts(batches, most: int):
        """Runs of rows of about `most` bytes of text, as (ids, texts)."""
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= most:
                    yield ids, texts, size
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts, size

    def first(batches):
        from pyspark import TaskContext

        aligner, part, n, held, size = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0, [], 0

        def block():
            every = np.concatenate([h[3][1] for h in held])
            pairs, at = np.unique(every, return_inverse=True)
            numbers, begun, docs = np.concatenate([h[3][2] for h in held]), 0, np.bincount(at, minlength=len(pairs))
            lead = True
            for ids, counts, digests, (doc, _, number) in held:
                cuts = begun + np.searchsorted(doc, np.arange(len(ids) + 1))
                begun += len(doc)
                cut = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                links = [squeezed(at[x:y], numbers[x:y]) for x, y in cut]
                total = [int(numbers[x:y].sum()) for x, y in cut]
                none = [None] * (len(ids) - 1)
                columns = [[part << 24 | n] * len(ids), ids, *counts.T.tolist(), total, digests, [y - x for x, y in cut], links, [pairs.tolist() if lead else None, *none], [docs.tolist() if lead else None, *none]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                lead = False

        for ids, texts, chars in parts(batches, PIECE):
            held.append((ids, *aligner.aligned(texts)))
            size += chars
            if size >= block_chars:
                yield from block()
                n, held, size = n + 1, [], 0
        if held:
            yield from block()

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "links", "pairs", "docs"]
    kinds = [*[pa.int64()] * 6, pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = keep(rows.mapInArrow(first, "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs int, links binary, pairs array<int>, docs array<int>"), "linked")

    pairs = held.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", SHIFT))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    scored = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.select(F.col("block").alias("to_block"), "pair").join(scored, "pair")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        n_best, total = [], []
        for n, data in zip(left.column("n_pairs").to_pylist(), left.column("links").to_pylist()):
            at, number = opened(data, n)
            n_best.append(int(number[best[at]].sum()))
            total.append(int((number * count[at]).sum()))
        return pa.table([*(left.column(c) for c in COLUMNS[:5]), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("groups_sha256")], list(COLUMNS))

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in COLUMNS)
    return held.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(finish, schema)
