"""Toxicity: a noisy channel restores disguised words, a classifier scores the restored text.

1. A character language model: trigram counts over the words of all documents.
2. Tokens become lattices: every character may stand for the letters it imitates, for itself, or
   for nothing (separators, repetitions), each at a cost. The Viterbi path of least cost under
   channel and language model is the restored word. Tokens of any length are read; they are split
   at punctuation that is no imitation, what stands at a piece's edges stays, and so do pieces
   without any letter. Letters one by one between separators are one word. Tokens without
   digits, symbols, separators or repeated letters have one path only and skip the lattice;
   where repeated letters are the only choice, the best path is found run by run (see `Decoder.runs`).
3. Hashed presence of whole restored words and of their beginnings and endings, in one or in several words, scored by a logistic regression.

An empty or null text scores the bias alone.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .quality import held_out
from .wordhash import mixed

TOXIC_FROM, SAMPLE = 0.7, 12_000
#: What a character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li",
    "+": "t", "€": "e", "*": "aeiou", "(": "c", "#": "h", "&": "a",
}
SEPARATORS = " .-_*'"
#: Costs in nats: an imitation, a dropped separator, a dropped repetition (of two, of more), a character kept that is no letter.
IMITATES, DROPS, HALVES, SHORTENS, KEEPS = 0.7, 0.5, 4.0, 0.3, 6.0
CLASSES = 64
#: What is taken off both ends of a piece before it is restored, with symbols three times or more.
EDGES = ".,;:?!\"'()[]{}<>-_*#%&~`"
RAGGED = re.compile(rf"^(?:[{re.escape(EDGES)}]|([^\w\s])\1\1+)+|(?:[{re.escape(EDGES)}]|([^\w\s])\2\2+)+$")
IMITATIONS = "".join(re.escape(c) for c in LEET if not c.isalnum())
#: Four or more letters or imitations one by one between separators.
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{IMITATIONS}])(?:[ .\-_*](?:[^\W_]|[{IMITATIONS}])){{3,}}(?![^\W_])")
#: What viterbi() can read: letters, imitations, separators; a token is split at anything else.
PIECES = re.compile(rf"(?:[^\W_]|[{IMITATIONS}{re.escape(SEPARATORS)}])+")
#: Where viterbi() has more than one option: an imitation, a separator, a letter repeated.
FORKS = re.compile(rf"[{IMITATIONS}0-9{re.escape(SEPARATORS.strip())}]|([^\W\d_])\1", re.I)
WORDS = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1+")


def char_class(c: str) -> int:
    """0 for what is no letter, 1 to 26 for a to z, above for other letters."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0


def class_table() -> np.ndarray:
    """The class of every code point (lower case) below 0x3000; those above are letters by their remainder."""
    return np.asarray([char_class(chr(i).lower()[:1]) for i in range(0x3000)], np.int32)


def codes(text: str, table: np.ndarray) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where(x < len(table), table[np.minimum(x, len(table) - 1)], 27 + x % 37)


def trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of class trigrams within words, over all documents: CLASSES**3 numbers, whatever their amount."""

    def counted(batches):
        table, total = class_table(), np.zeros(CLASSES**3, np.int64)
        for b in batches:
            held = []
            for t in b.column("text").to_pylist():
                if t:
                    c = np.concatenate([[0, 0], codes(t, table), [0]])
                    grams = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
                    held.append(grams[(c[1:-1] > 0) | (c[2:] > 0)])
            if held:
                total += np.bincount(np.concatenate(held), minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**3)
    for r in rows:
        out[r.gram] = r.n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b) by class, smoothed with P(c | b)."""
    n = counts.reshape(CLASSES, CLASSES, CLASSES)
    pair = n.sum(axis=0) + 0.1
    pair /= pair.sum(axis=1, keepdims=True)
    strength = 5.0
    return -np.log((n + strength * pair[None]) / (n.sum(axis=2, keepdims=True) + strength)).astype(np.float32)


class Decoder:
    """Restores single tokens; keeps what it has restored."""

    def __init__(self, model: np.ndarray):
        self.cost = model
        self.price = model.ravel().tolist()
        self.known: dict[str, str] = {}

    def restore(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            # What strip takes off is an edge of the token's first or last piece and stays anyway.
            found = self.known[token] = PIECES.sub(self._piece, token) if FORKS.search(token.strip(".,;:?'\"")) else token
        return found

    def _piece(self, match: re.Match) -> str:
        """A part of a token between other punctuation; what it has at its edges stays."""
        piece = match[0]
        core = RAGGED.sub("", piece)
        if not FORKS.search(core) or not any(map(str.isalpha, core)):
            return piece
        seen, at = core.lower(), piece.index(core)
        made = self.runs(seen) if seen.isalpha() else self.viterbi(seen)
        return piece if made == seen else piece[:at] + made + piece[at + len(core) :]

    def runs(self, seen: str) -> str:
        """What `viterbi` makes of letters only, where each run of a letter becomes two of it or one.

        A run's choice changes the trigrams that end in its second letter and in the letter after
        it; the next trigram has the same two letters before it in either case. So runs are chosen one by one.
        """
        price = self.price

        def chosen(m: re.Match) -> str:
            c, n = char_class(m[1]), m.end() - m.start()
            before = char_class(seen[m.start() - 1]) if m.start() else 0
            after = char_class(seen[m.end()]) if m.end() < len(seen) else 0
            two = price[before << 12 | c << 6 | c] + price[c << 12 | c << 6 | after] + SHORTENS * (n - 2)
            one = price[before << 12 | c << 6 | after] + (HALVES if n == 2 else SHORTENS * (n - 1))
            return m[1] if one < two else m[1] * 2

        return REPEATED.sub(chosen, seen)

    def spaced(self, match: re.Match) -> str:
        s = match[0]
        return self.viterbi(s.lower(), apart=False) if len(set(s)) > 3 and any(map(str.isalpha, s)) else s

    def viterbi(self, seen: str, apart: bool = True) -> str:
        """The string of letters of least channel and language-model cost; with `apart`, separators may stay and end a word."""
        price = self.price
        groups = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", seen, re.S)]
        # By place, the states (last two classes, as one number) with cost and path (path before, string).
        states: list[dict[int, tuple[float, tuple | None]]] = [{0: (0.0, None)}] + [{} for _ in groups]
        for i, (c, n) in enumerate(groups):
            options: list[tuple[str, float, int]] = []
            if c.isalpha():
                options.append((c * min(n, 2), SHORTENS * max(0, n - 2), i + 1))
                if n > 1:
                    options.append((c, HALVES if n == 2 else SHORTENS * (n - 1), i + 1))
            else:
                options += [(x * k, IMITATES * n + (SHORTENS if k < n else 0), i + 1) for x in LEET.get(c, "") for k in {1, min(n, 2)}]
                if n == 2 and len(LEET.get(c, "")) == 2:  # one sign for two different letters: k!!l
                    options += [(x + y, IMITATES * n, i + 1) for x, y in (LEET[c], LEET[c][::-1])]
                if c in SEPARATORS:
                    options.append(("", DROPS * n if n < 3 else DROPS, i + 1))
                    if apart:
                        options.append((c * n, 0.0, i + 1))
                else:
                    options.append((c * n, KEEPS * n, i + 1))
                    if c.isdigit() and (i == 0 or not groups[i - 1][0].isdigit()):
                        end = i
                        while end < len(groups) and groups[end][0].isdigit():
                            end += 1
                        options.append(("".join(x * k for x, k in groups[i:end]), KEEPS, end))
            paths = [(string, [char_class(ch) for ch in string], cost, end) for string, cost, end in options]
            for at, (cost, path) in states[i].items():
                for string, classes, more, end in paths:
                    x, total = at, cost + more
                    for k in classes:
                        x = x << 6 | k
                        total += price[x]
                        x &= 0xFFF
                    known = states[end].get(x)
                    if known is None or total < known[0]:
                        states[end][x] = (total, (path, string))
            states[i] = {}
        path = min(((cost + price[x << 6], x, path) for x, (cost, path) in states[-1].items()), key=lambda s: s[:2])[2]
        out = []
        while path:
            path, string = path
            out.append(string)
        return "".join(reversed(out))


def flags() -> np.ndarray:
    """Whether a code point below 0x3000 may be a letter of a word spelt letter by letter; those above all may."""
    return np.asarray([chr(i).isalnum() or chr(i) in LEET for i in range(0x3000)], bool)


def spelt(text: str, table: np.ndarray) -> bool:
    """Whether a text may have a word written letter by letter."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if len(x) < 7:
        return False
    letter = table[np.minimum(x, 0x2FFF)]
    # Separators may be imitations, too (*): two places apart is what all such words have.
    edge = np.concatenate([[True], ~letter | (x == 42), [True]])
    single = letter & edge[:-2] & edge[2:]
    return bool((single[:-6] & single[2:-4] & single[4:-2] & single[6:]).any())


def restorer(model: np.ndarray):
    """A callable text -> restored text."""
    decoder, table = Decoder(model), flags()

    def of(text: str) -> str:
        if spelt(text, table):
            text = SPACED.sub(decoder.spaced, text)
        return re.sub(r"\S+", lambda m: decoder.restore(m[0]), text) if FORKS.search(text) else text

    return of


def slots_of(words: list[str]) -> np.ndarray:
    """For each word the slots of itself, of its first and of its last five, six and seven letters, -1 where it has no more letters than that."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(n) - n
    letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    powers = np.full(max(int(n.max()), 7), linear.M1)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    whole = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(starts, n)], starts)
    place = np.arange(7)
    head = letters[np.minimum(starts[:, None] + place, len(letters) - 1)] * powers[place]
    tail = letters[np.maximum((starts + n)[:, None] - 7 + place, 0)] * powers[place]
    columns = [(whole, n > 0, 11)]
    for k in (5, 6, 7):
        columns += [(head[:, :k].sum(axis=1), n >= k, 12 + k), (tail[:, 7 - k :].sum(axis=1), n > k, 22 + k)]
    return np.stack([np.where(has, linear.slots(mixed(h), stream).astype(np.int64), -1) for h, has, stream in columns], axis=1)


def features(model: np.ndarray):
    """A callable that makes a callable text -> (slots, values): whole restored words of any length, and the first and last five to seven letters of words, once, twice, three and five times or more by the number of different words that have them."""
    held = []

    def build():
        decoder, table = Decoder(model), flags()

        class Tokens(dict):
            """Token -> numbers of its restored words, whose slots are the rows of `slots`."""

            def __init__(self):
                self.words: dict[str, int] = {}
                self.new: list[str] = []
                self.slots = np.zeros((0, 7), np.int64)

            def __missing__(self, token: str) -> tuple[int, ...]:
                found = []
                for w in WORDS.findall(decoder.restore(token).lower()):
                    if w not in self.words:
                        self.words[w] = len(self.words)
                        self.new.append(w)
                    found.append(self.words[w])
                self[token] = out = tuple(found)
                return out

            def of(self, numbers: set[int]) -> np.ndarray:
                if self.new:
                    n = len(self.words) - len(self.new)
                    if len(self.slots) < len(self.words):
                        self.slots = np.concatenate([self.slots[:n], np.full((len(self.words), 7), -1)])
                    self.slots[n : len(self.words)] = slots_of(self.new)
                    self.new.clear()
                return self.slots[np.fromiter(numbers, np.int64, len(numbers))].ravel()

        tokens = Tokens()

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal tokens
            if spelt(text, table):
                text = SPACED.sub(decoder.spaced, text)
            if len(tokens) > 200_000:
                tokens = Tokens()
            # The words of the restored text are those of its restored tokens.
            found = tokens.of(set().union(*map(tokens.__getitem__, set(text.split()))))
            found = np.sort(found[found >= 0])
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if found.size else np.zeros(0, np.int64)
            at, n = found[starts], np.diff(starts, append=found.size)
            more = [linear.slots(at[n >= k].astype(np.uint64), 20 + k).astype(np.int64) for k in (2, 3, 5)]
            at = np.sort(np.concatenate([at, *more]))
            at = at[np.append(True, at[1:] != at[:-1])] if at.size else at
            return at, np.ones(len(at))

        return of

    def make():
        """One callable for all batches of a task: tokens are restored once."""
        if not held:
            held.append(build())
        return held[0]

    return make


def restored(docs: DataFrame, text: str = "text", into: str = "restored") -> DataFrame:
    """`docs` with the restored text in `into`; null texts stay null, all rows and other columns stay."""
    model = log_model(trigrams(docs, text))

    def made(texts: pa.Array) -> pa.Array:
        of = restorer(model)
        return pa.array([None if t is None else of(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(into, F.arrow_udf(made, "string")(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, into: str = "score") -> DataFrame:
    """`docs` with each whole text's toxicity in `into` (0 to 1).

    The language model counts all documents; the classifier learns from at most `limit` labelled
    rows, none of which is in the held-out fold (crc32 of the key mod 3 is 1).
    """
    make = features(log_model(trigrams(docs)))
    weights = linear.fit(docs, linear.labelled_sample(labels, "toxic", ~held_out("doc_id", 3, 1), limit), make, epochs=4, alpha=1.0, beta=1.0, l1=3.0, calibrate=True)
    return linear.score(docs, weights, make, into=into)


def digest(df: DataFrame) -> DataFrame:
    """The columns that the registered query returns, from doc_id and score."""
    return df.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
