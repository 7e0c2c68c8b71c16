"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Index. Items are indexed by their words. A posting holds an item and its BM25 weight for the word,
divided by the sum of the item's weights, so an item's score for a passage that holds all its words is
1 and one threshold serves all items. Postings are sorted by item and cut in blocks, each with its
largest weight. Items are kept in classes by length, powers of two, each with an index of its own.

Queries. For a class of items of up to m words, a document's passages are its windows of 1.25 m words,
a quarter of m apart; some passage holds any run of m words. Block-max WAND retrieves all items at the
threshold or above: the words' largest weights bound what a passage can reach; passages whose bound is
too low have no pivot and end there (all windows of a document are bounded at once, for each block of items); for
the others, cursors go through the postings, jumping by pivot and by block.

Verification. An item is split in question and answer (at an "answer:" mark, else its last line, else
its last quarter). A document is reported for an item if enough of the question's and of the answer's
five-word shingles occur in it.

Scale. Documents are not shuffled. Items are indexed in blocks of bounded size, written to the shared
folder one by one; a task holds one block at a time and passes it over a piece of its documents, so memory
is bounded however many items there are. Counts of words over items come from all items.

Words are runs of letters, digits and underscores; in scripts without spaces (Chinese, Japanese, Thai)
each character is a word.

Defined cases: null or empty documents match nothing. Items under ``min_words`` words are found where they
are a whole line of a document (score and overlaps 1): as parts of lines, words so few prove nothing. Null
and empty items are not searched. Repeated items and documents give repeated rows. Other columns pass through.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import keeps, lean, only, pieces, with_columns
from quern.storage import new_dir, open_fs

_UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_PLAIN = re.compile(r"\w+")
_ANSWER = re.compile(r"(?im)^\s*(?:answer|a)\s*[:.]")
_QUESTION = re.compile(r"(?i)^\s*(?:question|q)\s*[:.]")
_BLOCK = 32
#: Blocks of items by which a document's windows are bounded before any is searched.
_GROUPS = 12


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    text = (text or "").lower()
    return _PLAIN.findall(text) if text.isascii() else _WORDS.findall(text)


def split_item(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer."""
    if mark := _ANSWER.search(text):
        parts = _QUESTION.sub("", text[: mark.start()]), text[mark.end() :]
    else:
        parts = text.rstrip().rpartition("\n")[::2]
    question, answer = map(words_of, parts)
    if not question or not answer:
        whole = question + answer
        cut = max(1, len(whole) - max(1, len(whole) // 4))
        question, answer = whole[:cut], whole[cut:]
    return question, answer


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    """Runs of ``width`` words; all words if there are fewer."""
    width = min(width, len(words))
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if width else set()


class Postings:
    """One word's items in a class, in blocks."""

    __slots__ = ("items", "weights", "most", "block_most", "block_last")

    def __init__(self, pairs: list[tuple[int, float]]):
        pairs.sort()
        self.items = [i for i, _ in pairs]
        self.weights = [w for _, w in pairs]
        self.most = max(self.weights)
        starts = range(0, len(pairs), _BLOCK)
        self.block_most = [max(self.weights[k : k + _BLOCK]) for k in starts]
        self.block_last = [self.items[min(k + _BLOCK, len(pairs)) - 1] for k in starts]


class ItemIndex:
    """Items of like length and their postings."""

    def __init__(self, length: int, postings: dict[int, Postings], vocabulary: int):
        self.length, self.postings = length, postings
        members = sorted({i for p in postings.values() for i in p.items})
        group = {i: k * min(_GROUPS, len(members)) // len(members) for k, i in enumerate(members)}
        self.most = np.zeros((max(group.values()) + 1, vocabulary + 1), np.float32)
        for term, p in postings.items():
            for i, w in zip(p.items, p.weights, strict=True):
                self.most[group[i], term] = max(w, self.most[group[i], term])
        self.most *= 1 + 1e-5  # rounding must not lower a bound
        self.top = self.most.max(0)
        self.bounds = self.top.tolist().__getitem__

    def passages(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """The windows whose words can reach the threshold on some block of items."""
        step = self.length // 4
        starts = np.arange(0, max(1, len(ids) - self.length + step), step)
        ends = np.minimum(starts + self.length + step, len(ids))
        bound = np.concatenate([[0.0], np.cumsum(self.top[ids], dtype=np.float64)])
        reach = np.flatnonzero(bound[ends] - bound[starts] >= threshold)
        if not len(reach):
            return []
        starts, ends = starts[reach], ends[reach]
        at = starts[:, None] + np.arange(self.length + step)
        inside = np.where(at < ends[:, None], ids[np.minimum(at, len(ids) - 1)], len(self.top) - 1)
        reach = np.zeros(len(starts), bool)
        for most in self.most:
            reach |= most[inside].sum(1) >= threshold
        return list(zip(starts[reach].tolist(), ends[reach].tolist(), strict=True))

    def search(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score ``threshold`` or more for the distinct terms, by block-max WAND."""
        threshold -= 1e-9
        lists = sorted((self.postings[t] for t in terms if t in self.postings), key=lambda p: p.most)
        spare, light = 0.0, 0  # words so common that together they can't decide: they only add to scores
        while light < len(lists) and spare + lists[light].most < 0.1 * threshold:
            spare += lists[light].most
            light += 1
        extra = lists[:light]
        need = threshold - spare
        cursors = [[p.items[0], 0, p] for p in lists[light:]]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].most
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, end = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                b = bisect_left(c[2].block_last, item)
                if b < len(c[2].block_last):
                    bound += c[2].block_most[b]
                    end = min(end, c[2].block_last[b] + 1)
            if bound < need:  # no item before the first of these blocks ends can reach it
                target = max(end, item + 1) if end < 1 << 60 else 1 << 60
            elif cursors[0][0] == item:
                score = sum(c[2].weights[c[1]] for c in cursors[: pivot + 1])
                for p in extra if score >= need else ():
                    k = bisect_left(p.items, item)
                    if k < len(p.items) and p.items[k] == item:
                        score += p.weights[k]
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    c[1] = bisect_left(c[2].items, target, c[1])
                    c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


class Benchmark:
    """A block of items: their indexes by length, and what verification needs."""

    def __init__(self, items: list[tuple[object, str]], n_items: int, mean_length: float, frequency: dict[str, int], width: int, min_words: int = 1, k1: float = 1.2, b: float = 0.75):
        short = [(i, words_of(t)) for i, t in items if len(words_of(t)) < min_words]
        items = [(i, t) for i, t in items if len(words_of(t)) >= min_words]
        self.lines: dict[tuple[str, ...], list] = defaultdict(list)
        for i, own in short:
            self.lines[tuple(own)].append(i)
        self.longest = max((sum(map(len, own)) + 8 * len(own) for _, own in short), default=0)
        self.ids = [i for i, _ in items]
        self.parts = [tuple(shingles(part, width) for part in split_item(text)) for _, text in items]
        self.terms: dict[str, int] = {}
        lists: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            length = 1 << max(4, (len(words) - 1).bit_length())
            weights = {}
            for word, n in Counter(words).items():
                idf = math.log(1 + (n_items - frequency[word] + 0.5) / (frequency[word] + 0.5))
                weights[word] = idf * n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / mean_length))
            total = sum(weights.values())
            for word, w in weights.items():
                lists[length][self.terms.setdefault(word, len(self.terms))].append((k, w / total))
        self.indexes = [ItemIndex(n, {t: Postings(p) for t, p in own.items()}, len(self.terms)) for n, own in sorted(lists.items())]

    def leaks(self, text: str, threshold: float, width: int, question: float, answer: float) -> list[tuple[object, float, float, float]]:
        """Items found in a text: id, best score, overlap of question and of answer."""
        words = words_of(text)
        if not words:
            return []
        whole = self._whole_lines(text) if self.lines else []
        get, none = self.terms.get, len(self.terms)
        own = [get(w, none) for w in words]
        ids = np.array(own, np.int64)
        best: dict[int, float] = {}
        for index in self.indexes:
            for start, end in index.passages(ids, threshold):
                terms = set(own[start:end])
                if sum(map(index.bounds, terms)) >= threshold:
                    for item, score in index.search(terms, threshold):
                        best[item] = max(score, best.get(item, 0.0))
        if not best:
            return whole
        have: dict[int, set] = {}
        out = []
        for item, score in sorted(best.items()):
            overlaps = []
            for part in self.parts[item]:
                n = len(next(iter(part))) if part else 0
                if n not in have:
                    have[n] = shingles(words, n)
                overlaps.append(sum(x in have[n] for x in part) / len(part) if part else 1.0)
            if overlaps[0] >= question and overlaps[1] >= answer:
                out.append((self.ids[item], score, *overlaps))
        return out + whole

    def _whole_lines(self, text: str) -> list[tuple[object, float, float, float]]:
        """Short items that are a line of the text."""
        found = {i: None for line in text.split("\n") if len(line) <= 4 * self.longest and (own := tuple(words_of(line))) in self.lines for i in self.lines[own]}
        return [(i, 1.0, 1.0, 1.0) for i in found]


def _blocks(items: DataFrame, id_col: str, text_col: str, min_words: int, width: int, max_bytes: int) -> Iterator[Benchmark]:
    """The items in blocks of about ``max_bytes`` of text."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = words_of(text)
                if len(own) >= min_words:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(set(own))), pa.array([len(own), *[0] * (len(set(own)) - 1)], pa.int64())], names=["word", "n"])

    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("length(text) > 0")
    counted = items.select("text").mapInArrow(terms, "word string, n long")
    size, = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_items, length = counted.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = max(1, -(-size // max_bytes))
    for k in range(blocks if size else 0):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows = [(r.id, r.text) for r in own.collect() if words_of(r.text)]
        frequency = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        if blocks > 1:  # of this block's words only
            frequency = frequency.join(own.select("text").mapInArrow(terms, "word string, n long").select("word").distinct(), "word", "left_semi")
        if rows:
            yield Benchmark(rows, n_items, (length or 0) / max(1, n_items), {r.word: r.df for r in frequency.collect()}, width, min_words)


#: The block that this Python worker read last, by its file.
_READ: dict[str, Benchmark] = keeps()


def _block(uri: str) -> Benchmark:
    if uri not in _READ:
        only(_READ)
        _READ.clear()
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as f:
            _READ[uri] = pickle.loads(f.read())
    return _READ[uri]


def mark_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    question: float = 0.8,
    answer: float = 0.5,
    min_words: int = 5,
    max_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with leaks: per item found, its id, score and the overlap of its question and answer.

    leaks takes the place of a column of that name.
    """
    kind = f"array<struct<item_id:{items.schema[item_id_col].dataType.simpleString()},score:double,question:double,answer:double>>"
    names = ("item_id", "score", "question", "answer")
    folder = new_dir(docs.sparkSession, "benchmark")
    uris = []
    for k, block in enumerate(_blocks(items, item_id_col, item_text_col, min_words, width, max_bytes)):
        fs, path = open_fs(f"{folder}/{k}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(pickle.dumps(block))
        uris.append(f"{folder}/{k}")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch, text_col):
                texts = part.column(text_col).to_pylist()
                found: list[list[dict]] = [[] for _ in texts]
                for uri in uris:
                    for own, text in zip(found, texts, strict=True):
                        own += [dict(zip(names, x, strict=True)) for x in _block(uri).leaks(text, threshold, width, question, answer)] if text else []
                yield part, {"leaks": found}

    return with_columns(docs, [("leaks", kind)], lean(run, alone=False))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold an item; all columns stay."""
    aside = "leaks"
    while aside in docs.columns:
        aside += "_"
    marked = mark_leaks(docs.withColumnRenamed("leaks", aside), items, **options)
    kept = marked.filter(F.size("leaks") == 0).drop("leaks")
    return (kept.withColumnRenamed(aside, "leaks") if "leaks" in docs.columns else kept).select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = mark_leaks(docs, items).select("doc_id", F.explode("leaks").alias("x"))
    return found.select("doc_id", F.col("x.item_id").alias("item_id"), F.round("x.score", 6).alias("score"), F.col("x.question").alias("question_overlap"), F.col("x.answer").alias("answer_overlap"))
