"""Token counts of every prefix by dynamic programming over byte-pair encodings.

Joined pieces are a valid encoding if and only if each two neighbours are what their own text is
encoded as. So a prefix ends with the one piece that follows validly on the last piece of the
prefix before it, and its count is one more than that prefix's. One pass over a text gives the
count of each of its prefixes; how much of a text fits a budget, or how many tokens the first
characters take, is then looked up, not encoded again.

No piece goes across the beginning of a word, so the pass is made once for each distinct word and
the counts of words are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import kept_by_worker, text_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"
# Distinct words and their parts with their counts, and pairs of pieces, that a worker remembers; when full, the
# memory starts anew. Longer words are not remembered.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
# First characters of a part whose counts are remembered for all parts that begin so.
HEAD = 7
CONTROL_WHITE_SPACE = "\n\r\t"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a byte-pair model, how it encodes short strings, and counts of all prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " A  ÄÁ\nﬁ "
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("only models that leave characters as they are and mark the beginning of a text are supported")
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.scores))
        self.bytes_fall_back = any(model.is_byte(i) for i in range(model.get_piece_size()))
        joined = [piece for piece in self.scores if len(piece) > 1]
        if any(BLANK in piece.lstrip(BLANK) for piece in joined):
            raise ValueError("pieces that go across the beginning of a word are not supported")
        inside = set("".join(joined))
        apart = "".join(c for c in CONTROL_WHITE_SPACE if c not in inside)
        self.words = re.compile(f"{BLANK}*[^{BLANK}{apart}]+|{BLANK}+" + (f"|[{apart}]" if apart else "")).findall
        # Where two characters stand side by side in no piece, a text falls apart.
        self.beside = {piece[i : i + 2] for piece in joined for i in range(len(piece) - 1)}
        self.histories: dict[str, tuple[list, list, bool]] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        # Lengths of the pieces that come out whole, longest first, by their last two characters.
        self.lengths: dict[str, list[int]] = {}
        self.tokens = {piece for piece in joined if self.is_whole(piece)}
        for piece in self.tokens:
            self.lengths.setdefault(piece[-2:], []).append(len(piece))
        self.lengths = {end: sorted(set(found), reverse=True) for end, found in self.lengths.items()}
        self.heads: dict[str, tuple[list[int], list[str]]] = {}
        self.known: dict[str, list[int]] = {}
        self.sums: dict[str, int] = {}

    def history(self, piece: str) -> tuple[list, list, bool]:
        """How the two ends of a piece grow while it is encoded: (score of the next join, end) for the
        left and for the right end, a last one without a score; and whether the piece comes out whole."""
        known = self.histories.get(piece)
        if known is None:
            parts, left, right = list(piece), [], []
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = self.scores.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                left.append((best, parts[0]))
                right.append((best, parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.histories[piece] = left, right, len(parts) == 1
        return known

    def is_whole(self, piece: str) -> bool:
        return self.history(piece)[2]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether two whole pieces side by side stay apart: at no time is the join across them the best one, of ties the first."""
        pair = left, right
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) >= REMEMBERED:
                self.follows.clear()
            known = self.follows[pair] = self.stay_apart(self.history(left)[1], self.history(right)[0])
        return known

    def stay_apart(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (score, end), (other, begin) = left[i], right[j]
            across = self.scores.get(end + begin)
            if across is not None and (score is None or across > score) and (other is None or across >= other):
                return False
            if score is None and other is None:
                return True
            if other is None or (score is not None and score >= other):
                i += 1
            else:
                j += 1

    def cost(self, piece: str) -> int:
        """Ids of a piece: one, or one per byte of a character the model does not know."""
        return 1 if piece in self.scores or not self.bytes_fall_back else len(piece.encode("utf-8", "surrogatepass"))

    def parts(self, word: str) -> list[str]:
        """A word cut where its characters stand side by side in no piece."""
        beside = self.beside
        edges = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in beside], len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:])]

    def prefixes(self, part: str) -> list[int]:
        """The number of ids of each prefix of a part, from one character to all."""
        head = part[:HEAD]
        if len(part) > HEAD:
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) >= REMEMBERED:
                    self.heads.clear()
                known = self.heads[head] = self.extend(head, [0], [""])
            counts, last = known[0].copy(), known[1].copy()
        else:
            counts, last = [0], [""]
        return self.extend(part, counts, last)[0][1:]

    def extend(self, part: str, counts: list[int], last: list[str]) -> tuple[list[int], list[str]]:
        """Counts and last pieces of a part's prefixes, given those of its first ones."""
        lengths, tokens, follows = self.lengths, self.tokens, self.follows
        for end in range(len(counts), len(part) + 1):
            piece = part[end - 1]
            for length in lengths.get(part[end - 2 : end], ()) if end > 1 else ():
                longer = part[end - length : end] if length <= end else ""
                if longer in tokens:
                    # Nothing is before the first piece.
                    if length == end:
                        piece = longer
                        break
                    apart = follows.get((last[end - length], longer))
                    if apart if apart is not None else self.may_follow(last[end - length], longer):
                        piece = longer
                        break
            counts.append(counts[end - len(piece)] + (1 if piece in self.scores else self.cost(piece)))
            last.append(piece)
        return counts, last

    def of_part(self, part: str) -> list[int]:
        """`prefixes`, remembered for parts of ordinary length."""
        counts = self.known.get(part)
        if counts is None:
            counts = self.prefixes(part)
            if len(part) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[part] = counts
        return counts

    def of_word(self, word: str) -> int:
        """The number of ids of a word, remembered if it is of ordinary length."""
        total = self.sums.get(word)
        if total is None:
            total = sum(self.of_part(part)[-1] for part in self.parts(word))
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.sums) >= REMEMBERED:
                    self.sums.clear()
                self.sums[word] = total
        return total

    def split(self, text: str) -> list[str]:
        return self.words(BLANK + text.replace(" ", BLANK)) if text else []

    def count(self, text: str) -> int:
        """The number of ids of a whole text."""
        words = self.split(text)
        try:
            return sum(map(self.sums.__getitem__, words))
        except KeyError:
            return sum(map(self.of_word, words))

    def of_text(self, text: str) -> np.ndarray:
        """The number of ids of each prefix of `text`, from the empty one to all of it."""
        parts = [self.of_part(part) for word in self.split(text) for part in self.parts(word)]
        before = np.cumsum([0, *(part[-1] for part in parts)])[:-1]
        out = np.concatenate([np.array(p, dtype=np.int32) + b for p, b in zip(parts, before)]) if parts else np.zeros(1, np.int32)
        # The mark at the beginning is no character of the text, and the empty prefix has no id.
        out[0] = 0
        return out.astype(np.int32)


def counted(docs: DataFrame, path: str | None, prefixes: bool) -> DataFrame:
    path = path or model_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_by_worker(f"pieces {path}", lambda: Pieces(path))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = [batch.column("doc_id"), batch.column("n_bytes")]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if prefixes:
                tables = [pieces.of_text(text) for text in texts]
                columns += [pa.array([int(table[-1]) for table in tables], pa.int64()), pa.array(tables, pa.list_(pa.int32()))]
                names.append("counts")
            else:
                columns.append(pa.array([pieces.count(text) for text in texts], pa.int64()))
            yield pa.record_batch(columns, names=names)

    rows = docs.select("doc_id", F.octet_length(text_of()).cast("bigint").alias("n_bytes"), text_of().alias("text"))
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint" + (", counts array<int>" if prefixes else "")
    return rows.mapInArrow(work, schema)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: ids of each whole text, without those that mark begin or end.

    A null text is an empty one, which has no id. Rows that repeat are counted each; an empty table
    gives no row; extra columns are not looked at.
    """
    return counted(docs, path, False).withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and counts: at place p the number of ids of the first p characters, from p = 0.

    Written once, the table answers the questions below by look-up. A null text has the counts [0].
    """
    return counted(docs, path, True)


def tokens_within(counts: Column, characters: Column | int) -> Column:
    """The number of ids that the first `characters` of a text take, all of it if it has fewer."""
    return F.get(counts, F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts) - 1))


def characters_within(counts: Column, budget: int) -> Column:
    """The most characters from the beginning that take at most `budget` ids; counts need not rise."""
    return F.array_max(F.transform(counts, lambda count, at: F.when(count <= budget, at)))


def truncated(docs: DataFrame, table: DataFrame, budget: int) -> DataFrame:
    """`docs` with each text cut to the most characters that take at most `budget` ids.

    `table` is the `prefix_counts` of `docs`; doc_id tells the rows apart and is there in each. A null
    text stays null. Columns of any name may come along.
    """
    kept = table.select(F.col("doc_id").alias("__of"), characters_within(F.col("counts"), budget).alias("__kept"))
    joined = docs.join(kept, docs["doc_id"] == kept["__of"])
    cut = F.substring(docs["text"], F.lit(1), kept["__kept"])
    return joined.select(*[cut.alias(c) if c == "text" else docs[c] for c in docs.columns])
