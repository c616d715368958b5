"""Spelling variants: words one edit apart, found in minimal automata that are matched half exactly from either end.

A word and a variant one edit away differ first at some place p.  Cut a word
into two halves: the half without p is found unchanged at the same end of the
variant.  So every word is posted under the region in which p may lie (its
back half or its front half) and all that lies outside of it; variants meet it
there by a key.  The words of many keys form one task's minimal acyclic
automaton, read forwards for back halves and backwards for front halves, whose
paths are numbered (perfect hash).  A region whose key is shared by very many
words is halved again, so no key's group grows with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOT_RUN = re.compile("[^A-Za-zÀ-ÿ]")
#: Least code points and least occurrences of a word; every NOISE-th checksum loses a code point; how much commoner a form is.
LEAST_CHARS, LEAST_COUNT, NOISE, COMMONER = 5, 3, 97, 2
#: Characters of a text looked at in one go, and distinct words a task holds before it passes counts on.
PIECE, HELD = 1 << 20, 100_000
#: Postings of a key beyond which its regions are halved, and of a task's automaton.
HOT, SHARD = 20_000, 60_000


# ---- words of the corpus ---------------------------------------------------------------------


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between letter runs."""
    at = 0
    while at < len(text):
        stop = NOT_RUN.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        yield text[at:end] if at or stop else text
        at = end


def spelled(run: str, head: int) -> str:
    """A run in lower case (A-Z only), without one code point if the checksum of its document and itself says so."""
    raw = run.encode().lower()
    h = zlib.crc32(raw, head)
    low = raw.decode()
    if h % NOISE == 0:
        k = h % len(low)
        return low[:k] + low[k + 1 :]
    return low


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least LEAST_CHARS code points that occur LEAST_COUNT times or more.

    Null texts hold none; a null doc_id counts as an empty one; repeated rows
    count again.  Tasks pass on sums of HELD distinct words at most, so a
    frequent word is shuffled once a task and piece of work, never once a place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                name, text = name.as_py(), text.as_py()
                head = zlib.crc32(f"{'' if name is None else name}:".encode())
                for piece in pieces(text or ""):
                    for found, n in Counter(RUN.findall(piece)).items():
                        if len(found) >= LEAST_CHARS:
                            word = spelled(found, head)
                            if len(word) >= LEAST_CHARS:
                                total[word] += n
                if len(total) >= HELD:
                    yield out()
        if total:
            yield out()

    words = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- automaton -------------------------------------------------------------------------------


class Automaton:
    """Minimal acyclic automaton of sorted distinct words, with their ranks as numbers.

    A state is a dict of character -> (state, words passed over by taking the
    other way); the words below are counted on the way up, so the numbers along
    a path add up to the word's rank.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        below: list[int] = []
        known: dict[tuple, int] = {}

        def state(ends: bool, ways: list[tuple[str, int]]) -> int:
            """The one state with these ways; ``ways`` come in the order of their characters."""
            key = (ends, *ways)
            if key not in known:
                edges, passed = {}, int(ends)
                for c, to in ways:
                    edges[c] = (to, passed)
                    passed += below[to]
                known[key] = len(self.edges)
                self.edges.append(edges)
                self.final.append(ends)
                below.append(passed)
            return known[key]

        # states of the last word that may still get ways: (ends a word, finished ways), one for each of its characters and one before them
        open_: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""
        for word in [*words, None]:
            same = 0
            if word is not None:
                most = min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
            for k in range(len(last), same, -1):
                ends, ways = open_.pop()
                open_[-1][1].append((last[k - 1], state(ends, ways)))
            if word is None:
                break
            open_ += [(k == len(word), []) for k in range(same + 1, len(word) + 1)]
            if not word:
                open_[0] = (True, open_[0][1])
            last = word
        self.root = state(*open_[0])

    def near(self, word: str, low: int, high: int) -> list[int]:
        """Numbers of the words one edit from ``word`` that keep its first ``low`` characters and those from ``high`` on.

        ``low`` characters are matched exactly; then states without an error
        and states after one are carried along together, so that ways which
        meet are walked once.
        """
        edges, at, number = self.edges, self.root, 0
        for c in word[:low]:
            way = edges[at].get(c)
            if way is None:
                return []
            at, number = way[0], number + way[1]
        size = len(word)
        exact: tuple[int, int] | None = (at, number)
        wrong: set[tuple[int, int]] = set()
        for i in range(low, size + 1):
            c = word[i] if i < size else None
            later: set[tuple[int, int]] = set()
            if exact is not None:
                at, number = exact
                if i <= high:
                    wrong.update([(to, number + more) for to, more in edges[at].values()])  # one more
                if i < high:
                    later.update([(to, number + more) for d, (to, more) in edges[at].items() if d != c])  # another one
                    later.add(exact)  # one less
                way = edges[at].get(c) if c is not None else None
                exact = (way[0], number + way[1]) if way else None
            if c is None:
                break
            for at, number in wrong:
                way = edges[at].get(c)
                if way is not None:
                    later.add((way[0], number + way[1]))
            wrong = later
            if exact is None and not wrong:
                return []
        return [number for at, number in wrong if self.final[at]]


def first_difference(a: str, b: str) -> int:
    most = min(len(a), len(b))
    for k in range(most):
        if a[k] != b[k]:
            return k
    return most


# ---- joins -----------------------------------------------------------------------------------

def _key(word: F.Column, size: F.Column, low: F.Column, high: F.Column) -> F.Column:
    """What a word of ``size`` characters would share with its variant ``word`` if they differ in [low, high) only."""
    behind = size - high
    tail = F.when(behind > 0, F.substring(word, F.length(word) - behind + 1, behind)).otherwise("")
    return F.xxhash64(size, low, high, F.substring(word, F.lit(1), low), tail)


def postings(words: DataFrame) -> DataFrame:
    """Each word under both halves of words of its own length (there it asks too), one less and one more."""
    sizes = words.select("word", "n", F.length("word").alias("own"), F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("size")).where(F.col("size") >= LEAST_CHARS)
    half = F.floor(F.col("size") / 2).cast("int")
    none = F.lit(0)
    both = sizes.select("*", F.explode(F.array(F.struct(half.alias("low"), F.col("size").alias("high")), F.struct(none.alias("low"), half.alias("high")))).alias("r"))
    out = both.select("word", "n", "size", "r.low", "r.high", (F.col("own") == F.col("size")).alias("asks"))
    return out.withColumn("key", _key(F.col("word"), F.col("size"), F.col("low"), F.col("high")))


def halved(posts: DataFrame) -> DataFrame:
    """Postings where no key has more than HOT rows, as far as its region can be halved.

    A region of one character leaves words that agree in all else, at most a
    few hundred.  Words too short for a narrower region's ends aren't posted
    there: they can't keep both.  Rounds grow with the logarithm of a word's length.
    """
    done = None
    while True:
        hot = posts.where("high - low > 1").groupBy("key").count().where(F.col("count") > HOT).select("key")
        hot = common.table(hot, "hot")
        if hot.isEmpty():
            return posts if done is None else done.unionByName(posts)
        calm = posts.join(hot, "key", "left_anti").select(posts.columns)
        done = calm if done is None else done.unionByName(calm)
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        split = posts.join(hot, "key", "left_semi").withColumn("r", F.explode(F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high")))))
        split = split.where(F.length("word") >= F.col("r.low") + F.col("size") - F.col("r.high")).select("word", "n", "size", "r.low", "r.high", "asks")
        posts = common.table(split.withColumn("key", _key(F.col("word"), F.col("size"), F.col("low"), F.col("high"))), "postings")


def matched(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of the asking words of one task's automaton, as far as their regions reach."""
    ahead = bool(key[0].as_py())
    number_of: dict[str, int] = {}
    asks = []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("word", "n", "size", "low", "high", "asks")]
        for word, n, size, low, high, ask in zip(*cols):
            number_of[word] = n
            if ask:
                asks.append((word, size, low, high))
    turned = sorted(w if ahead else w[::-1] for w in number_of)
    automaton = Automaton(turned)
    words, near, best_n, best = [], [], [], []
    for word, size, low, high in asks:
        numbers = automaton.near(word, low, high) if ahead else automaton.near(word[::-1], size - high, size - low)
        found = (turned[k] if ahead else turned[k][::-1] for k in numbers)
        # a pair counts in the region of its first difference alone, so it is never found twice
        found = [v for v in found if low <= (p := first_difference(word, v)) < high or p == high == size]
        if found:
            n, v = min((-number_of[v], v) for v in found)
            words.append(word)
            near.append(len(found))
            best_n.append(-n)
            best.append(v)
    columns = [pa.array(c, t) for c, t in zip((words, near, best_n, best), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
    yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words of the table (word, n) are one edit away, and the commonest (ties: smallest)."""
    spark = common.ready(words.sparkSession)
    posts = common.table(postings(words), "postings")
    posts = halved(posts)
    # a sum of what tasks count; enough shards that each holds about SHARD postings
    shards = max(1, -(-posts.count() // SHARD))
    posts = posts.withColumn("ahead", F.col("low") > 0).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    found = posts.drop("key").repartition(max(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ahead", "shard").groupBy("ahead", "shard").applyInArrow(matched, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("v"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.v").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) over (word, form): where following forms ends.

    Pointers are doubled; counts at least double from word to form, so a chain
    has at most 62 steps and six rounds are enough at any size.
    """
    root = common.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = root.select(F.col("word").alias("via"), F.col("root").alias("next"))
        both = common.table(root.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = both.select("word", "root")
        if both.where("moved").isEmpty():
            return root


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs`` (doc_id, text), their commoner near forms and where those end.

    Empty and null texts hold no words; texts and runs may have any length.
    Of near words with equal counts the smallest in code-point order is the
    form.  Repeated rows count each time.  An empty table gives no rows.
    """
    common.ready(docs.sparkSession)
    words = common.table(counted(docs), "words")
    form = F.col("best_n") >= COMMONER * F.col("n")
    near_n, best, best_n = F.coalesce("n_near", F.lit(0)).cast("long"), F.when(form, F.col("best")), F.when(form, F.col("best_n"))
    forms = words.join(near(words), "word", "left").select("word", best.alias("form"), "n", near_n.alias("n_near"), best_n.alias("form_n"))
    forms = common.table(forms, "forms")
    roots = rooted(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
