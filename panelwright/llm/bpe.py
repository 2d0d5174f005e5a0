"""BPE encoding and decoding through a distinct-word table.

Each partition's rows are taken in blocks of about `block_chars` bytes. A block's distinct words (a
space and what follows it up to the next one; where white space meets, the pieces of the
tokenizer's own split pattern) are dealt by word hash into BUCKETS buckets, and a bucket
encodes each distinct word once for all blocks of SHARE partitions. The ids go back to
the blocks that asked and are joined to the words by position. No step holds more than a
block or a bucket of one share; blocks times BUCKETS rows are dealt, so all grows in proportion
to the data. `decode` joins ids, as rows of any origin, to the id-to-piece table, whose size is
the vocabulary's, and joins the pieces by position.

Results equal the tokenizers library's on whole texts, special tokens in the text included.
Null texts are empty and have no ids; repeated rows are encoded like any other.
"""
from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


#: Buckets of a block's words; partitions whose blocks share a word's encoding.
BUCKETS, SHARE = 64, 32
#: White space of the split pattern (Unicode White_Space; the library's \s has no \x1c-\x1f).
BLANK = "\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


#: The same pattern for a library whose white space is that of Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """Splits texts at single spaces into words that are encoded alike whatever is around them.

    The pattern never joins what is on two sides of a space unless runs of white space meet
    there; texts with such runs, and texts with special tokens, are split by the pattern at once.
    """

    def __init__(self, special: list[str]):
        import re

        import regex

        self.words = regex.compile(SPLIT).findall
        self.special = frozenset(special)
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.runs = re.compile(f"[{BLANK}] (?:[{BLANK}]|$)").search

    def simple(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if text.isascii() and not any(b in text for b in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")):
            return True
        return not self.runs(text)

    def pieces(self, text: str) -> list[str]:
        """The words of any text, special tokens as they are."""
        parts = self.around.split(text) if self.around else [text]
        return [w for part in parts if part for w in ([part] if part in self.special else self.words(part))]


def specials(path: str) -> dict[str, int]:
    import json

    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str):
    """A callable word -> ids. The vocabulary's ids are in the order of its merges, so they serve as ranks."""
    import tiktoken

    known = specials(path).values()
    ranks = {piece: i for i, piece in enumerate(pieces_of(path)) if i not in known}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def squeezed(table: pa.Table) -> bytes:
    """A table as one compressed Arrow stream, to shuffle fewer bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def opened(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def encode(df: DataFrame, path: str | None = None, text: str = "text", into: str = "ids", decoded: str | None = None, block_chars: int = 16_000_000) -> DataFrame:
    """`df` with array<int> `into`: the ids of each row's whole text. The file at `path` has to be on every executor.

    `df` is read twice and has to come in the same partitions both times, as tables do (write
    other plans to one first); a difference ends in an error, never in wrong ids. A column
    already named `into` is replaced; other columns and all rows stay. A text longer than a block is a block.
    With `decoded`, what `decode` makes of the ids is added in the same task: one Python worker less for each.
    """
    path = path or default_path()
    df = df.drop(into, *([decoded] if decoded else []))
    pieces = pieces_of(path) if decoded else []
    special_ids = specials(path)
    special = list(special_ids)

    def runs(batches):
        """(block, batches) for every run of about block_chars code points of a partition."""
        from pyspark import TaskContext

        part, n, size, held = TaskContext.get().partitionId(), 0, 0, []
        for b in batches:
            held.append(b)
            size += b.column(text).nbytes
            if size >= block_chars:
                yield part << 24 | n, held
                n, size, held = n + 1, 0, []
        if held:
            yield part << 24 | n, held

    def dealt(held) -> list[list[str]]:
        """The distinct words of a run by bucket, in the order of their hashes."""
        import numpy as np
        import xxhash

        split, spaced, plain = Splitter(special), set(), set()
        for b in held:
            for t in b.column(text).to_pylist():
                if not t:
                    pass
                elif split.simple(t):
                    first, *more = t.split(" ")
                    plain.add(first)
                    spaced.update(more)
                else:
                    plain.update(split.pieces(t))
        plain.discard("")
        plain.update([" " + c for c in spaced])
        words = list(plain)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        if len(words) > 1 and (np.diff(hashes[order]) == 0).any():  # no order by hash: by text
            order = np.asarray(sorted(range(len(words)), key=words.__getitem__))
        out: list[list[str]] = [[] for _ in range(BUCKETS)]
        for i, bucket in zip(order.tolist(), (hashes[order] % np.uint64(BUCKETS)).tolist()):
            out[bucket].append(words[i])
        return out

    def gather(batches):
        for block, held in runs(batches):
            words = dealt(held)
            at = [i for i, ws in enumerate(words) if ws]
            blobs = [squeezed(pa.table({"w": pa.array(words[i], pa.string())})) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "words"])

    def pack(batches):
        for block, held in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeezed(pa.Table.from_batches(held))], pa.binary())], ["block", "rows"])

    loaded: list = []

    def encode_words(group):
        import numpy as np

        if not loaded:
            loaded.append(encoder(path))
        asked = [opened(x).column("w").to_pylist() for x in group.column("words").to_pylist()]
        words = list(dict.fromkeys(w for ws in asked for w in ws))
        ids = {w: [special_ids[w]] if w in special_ids else loaded[0](w) for w in words}
        blobs = []
        for ws in asked:
            got = [ids[w] for w in ws]
            counts, flat = np.fromiter(map(len, got), np.int32, len(got)), np.asarray([i for g in got for i in g], np.int32)
            narrow = lambda x: x.astype(np.uint16) if not x.size or x.max() < 65536 else x
            blobs.append(squeezed(pa.table({"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(narrow(flat)))})))
        return pa.table([group.column("block"), group.column("bucket"), pa.array(blobs, pa.binary())], ["block", "bucket", "ids"])

    columns = df.columns
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{into}` array<int>" + (f", `{decoded}` string" if decoded else "")

    def by_position(left, right):
        import numpy as np

        rows = opened(left.column("rows")[0].as_py())
        held = rows.to_batches(max_chunksize=1000)
        coded = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist()))
        spaced: dict[str, bytes] = {}
        plain: dict[str, bytes] = {}
        for bucket, words in enumerate(dealt(held)):
            if words:
                found = opened(coded.pop(bucket)).column("ids").combine_chunks()
                flat, at = found.values.to_numpy().astype("<i4").tobytes(), (4 * found.offsets.to_numpy().astype(np.int64)).tolist()
                for w, x, y in zip(words, at[:-1], at[1:], strict=True):
                    if w[0] == " ":
                        spaced[w[1:]] = flat[x:y]
                    else:
                        plain[w] = flat[x:y]
        split, of = Splitter(special), spaced.__getitem__
        parts = []
        for b in held:
            offsets, flat = [0], []
            for t in b.column(text).to_pylist():
                if not t:
                    got = b""
                elif split.simple(t):
                    first, *more = t.split(" ")
                    got = (plain[first] if first else b"") + b"".join(map(of, more))
                else:
                    got = b"".join([of(w[1:]) if w[0] == " " else plain[w] for w in split.pieces(t)])
                flat.append(got)
                offsets.append(offsets[-1] + len(got) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(flat))])
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
        out = pa.Table.from_batches(held, rows.schema).select(columns).append_column(into, pa.chunked_array(parts, pa.list_(pa.int32())))
        return out.append_column(decoded, pa.chunked_array(list(map(joiner(pieces), parts)), pa.string())) if decoded else out

    words = df.mapInArrow(gather, "block long, bucket int, words binary")
    # The upper bits of a block's number are its partition's.
    words = words.withColumn("share", F.shiftright("block", 24) / SHARE).withColumn("share", F.floor("share"))
    coded = words.groupBy("share", "bucket").applyInArrow(encode_words, "block long, bucket int, ids binary")
    packed = df.mapInArrow(pack, "block long, rows binary")
    return packed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(by_position, out_schema)


def pieces_of(path: str) -> list[bytes]:
    """The bytes of every id, in order: the vocabulary's id-to-piece table, of fixed size."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    known = set(specials(path))
    table = [b""] * tok.get_vocab_size()
    for piece, i in tok.get_vocab().items():
        table[i] = piece.encode() if piece in known else bytes(byte[c] for c in piece)
    return table


def joiner(table: list[bytes]):
    """A callable array of ids -> array of texts: every id's piece looked up in the table and joined by position."""
    import numpy as np

    lengths, joined = np.asarray([len(p) for p in table]), np.frombuffer(b"".join(table), np.uint8)
    starts = (np.concatenate([[0], np.cumsum(lengths)[:-1]])).astype(np.int32)
    lengths = lengths.astype(np.int32)

    def texts(column: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(column), 50):
            part = column[i : i + 50]
            ids, counts = part.flatten().to_numpy(), pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy()
            n = lengths[ids]
            ends = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=ends[1:])
            at = np.arange(ends[-1], dtype=np.int32)
            at += np.repeat(starts[ids] - ends[:-1], n)
            found = joined[at].tobytes()
            cut = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
            out += [found[a:b].decode(errors="replace") for a, b in zip(cut[:-1], cut[1:])]
        return pa.array(out, pa.string())

    return texts


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with string `into`: each row's ids looked up in the id-to-piece table and joined, special tokens kept.

    Null or empty ids give an empty text; bytes that are no UTF-8 give U+FFFD. A column already named `into` is replaced.
    """
    table, df = pieces_of(path or default_path()), df.drop(into)

    def pieces(batches):
        join = joiner(table)
        for b in batches:
            yield b.append_column(into, join(b.column(ids)))

    # Not a UDF column, which would queue whole rows on local disk while it waits.
    return df.mapInArrow(pieces, StructType([*df.schema.fields, StructField(into, StringType())]))


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def digest(df: DataFrame) -> DataFrame:
    """The columns that the registered query returns, from doc_id, ids and decoded."""
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
