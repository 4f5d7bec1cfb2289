"""Grouping of spelling variants through pairs of trie nodes.

The words are the keys of two tries, one over the words and one over the
reversed words, whose nodes are numbered.  A place in a word is then a pair of
whole numbers: the node of what stands before it and the node of what stands
after it.  Two words differ by one replaced letter if they have the same pair
around one skipped letter; a word differs from a longer one by an inserted
letter if its pair at a gap is the longer word's pair around a skipped letter.
Equal numbers mean equal strings, so neighbours are exact and no string is
compared.

The tries are never built as linked nodes.  In sorted words, the node of a
prefix is named by the first word that has it; a scan of each range of sorted
words needs only the word before.  What crosses a border between two ranges is
the path of one word a range, and these paths meet on the driver: one row a
task, whatever the number of words.

All words with one pair around a skipped letter differ in that letter alone,
so a group has at most as many rows as the alphabet has letters, and one more
for the word with the gap.  Counts and best neighbours come from window
functions over these groups; no pair of words is a row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stipendia.llm.common import saved

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT = 6, 5
RATIO = 5          # a form occurs at least so many times as often as its variant
DAMAGE = 199       # one run in so many loses a letter, see damaged
HELD = 1 << 20     # letters whose paths one batch carries
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(identifier: Column, run: Column, one_in: int = DAMAGE) -> Column:
    """The run, or the run without one letter where its hash with the id says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
            min_count: int = MIN_COUNT, one_in: int = DAMAGE) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, damaged as stated, with their occurrences.

    Null and empty texts have no words; a null id counts as the empty string; repeated rows count each.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(
        F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = rows.where(F.length("run") >= min_chars).select(damaged(F.col("id"), F.col("run"), one_in).alias("word"))
    return (words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _stitched(borders: list) -> list[tuple[int, int, list[int]]]:
    """(part, offset, carry) from (part, first, last, nodes, size): nodes a range shares with the words before it."""
    out, offset, word, nodes = [], 0, "", [0]
    for b in sorted(borders, key=lambda b: b.first):
        carry = nodes[:_shared(word, b.first) + 1]
        out.append((b.part, offset, carry))
        nodes = [carry[d] if x == d and d < len(carry) else x + offset for d, x in enumerate(b.nodes)]
        word, offset = b.last, offset + b.size
    return out


def trie_nodes(keys: DataFrame) -> DataFrame:
    """(key, number, nodes) for distinct non-empty ``key``: ``nodes[d]`` numbers the trie node of the first d letters.

    Equal prefixes have equal numbers and different ones different numbers; ``number`` ascends in code-point order.
    """
    ranged = keys.select("key").repartitionByRange("key").sortWithinPartitions("key")

    def scan(batches):
        part, base, word, nodes = TaskContext.get().partitionId(), 0, "", [0]
        for batch in batches:
            rows, held = ([], [], []), 0
            for key in batch.column(0).to_pylist():
                common = _shared(word, key)
                nodes = nodes[:common + 1] + list(range(base + common + 1, base + len(key) + 1))
                for column, value in zip(rows, (key, base, nodes)):
                    column.append(value)
                base, word, held = base + len(key) + 1, key, held + len(key)
                if held > HELD:
                    yield batch_of(part, rows)
                    rows, held = ([], [], []), 0
            yield batch_of(part, rows)

    def batch_of(part, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()),
             pa.array(rows[2], pa.list_(pa.int64()))], names=["part", "key", "base", "nodes"])

    local = saved(ranged.mapInArrow(scan, "part int, key string, base bigint, nodes array<bigint>"))
    borders = local.groupBy("part").agg(
        F.min("key").alias("first"), F.max_by(F.struct("key", "nodes"), "base").alias("end"),
        F.max(F.col("base") + F.size("nodes")).alias("size")).select("part", "first", F.col("end.key").alias("last"),
                                                                     F.col("end.nodes").alias("nodes"), "size").collect()
    ends = keys.sparkSession.createDataFrame(_stitched(borders), "part int, offset bigint, carry array<bigint>")
    # The first word of a range has base 0, so only nodes on its path are numbered by their own depth.
    whole = F.transform("nodes", lambda x, d: F.coalesce(F.when(x == d, F.get("carry", d)), x + F.col("offset")))
    return local.join(ends, "part").select("key", (F.col("base") + F.col("offset")).alias("number"), whole.alias("nodes"))


def places(words: DataFrame) -> DataFrame:
    """(p, s, skip, lead, id, n) for (word, n): the node pairs around every letter and at every gap of each word.

    ``skip`` says that a letter stands between the nodes.  ``lead`` marks the first letter of a run of equal ones:
    leaving out any of them gives the same word, so only that one stands for the shorter word.
    """
    forward = trie_nodes(words.select(F.col("word").alias("key"))).select(
        F.col("key").alias("word"), F.col("number").alias("id"), F.col("nodes").alias("f"))
    backward = trie_nodes(words.select(F.reverse("word").alias("key"))).select(
        F.reverse("key").alias("word"), F.col("nodes").alias("b"))
    rows = saved(words.join(forward, "word").join(backward, "word").select(
        "id", "word", "n", "f", "b", (F.size("f") - 1).alias("length"), F.split("word", "").alias("letters")))
    skips = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.struct(
        F.get("f", i).alias("p"), F.get("b", F.col("length") - 1 - i).alias("s"), F.lit(True).alias("skip"),
        F.coalesce(F.get("letters", i) != F.get("letters", i - 1), F.lit(True)).alias("lead")))
    gaps = F.transform(F.sequence(F.lit(0), F.col("length")), lambda i: F.struct(
        F.get("f", i).alias("p"), F.get("b", F.col("length") - i).alias("s"), F.lit(False).alias("skip"),
        F.lit(False).alias("lead")))
    return rows.select("id", "word", "n", F.concat(skips, gaps).alias("places"))


def near_words(placed: DataFrame) -> DataFrame:
    """(id, n_near, form_n, form): neighbours of each word that has any, and the commonest one, ties to the smaller id."""
    rows = placed.select("id", "n", F.inline("places")).select(
        "p", "s", "skip", "lead", "id", F.struct("n", (-F.col("id")).alias("back")).alias("me"))
    group = W.partitionBy("p", "s").orderBy(F.desc("skip"), F.desc("me")).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "skip", "lead", "id", "me", F.count_if("skip").over(group).alias("n_skip"), F.first("me").over(group).alias("best"),
        F.nth_value("me", 2).over(group).alias("next"), F.max(F.when(~F.col("skip"), F.col("me"))).over(group).alias("shorter"),
        F.count_if("lead").over(group).alias("n_longer"), F.max(F.when(F.col("lead"), F.col("me"))).over(group).alias("longer"))
    shorter = F.when(F.col("lead"), F.col("shorter"))
    replaced = F.when(F.col("n_skip") > 1, F.when(F.col("best") == F.col("me"), F.col("next")).otherwise(F.col("best")))
    found = rows.select(
        "id", F.when(F.col("skip"), F.col("n_skip") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
        .otherwise(F.col("n_longer")).alias("k"),
        F.when(F.col("skip"), F.greatest(replaced, shorter)).otherwise(F.col("longer")).alias("near"))
    return (found.where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.max("near").alias("near"))
            .select("id", "n_near", F.col("near.n").alias("form_n"), (-F.col("near.back")).alias("form")))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) for (id, form): the end of the chain of forms.

    Each round doubles the step.  Counts grow along a chain by the ratio, so chains are short: at most
    log(greatest count) / log(ratio) words, and the rounds the logarithm of that.
    """
    steps = saved(forms.select("id", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        longer = saved(steps.join(after, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = longer.select("id", "root")
        if not longer.where("moved").limit(1).count():
            return steps


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per distinct word of ``words`` (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one of the other.  ``form`` is the near
    word of greatest n, ties to the smallest in code-point order, if that n is at least ``ratio`` times the word's; else
    null.  ``root`` follows forms to the last; a word without a form is its own root.  Counts of repeated words are
    added; null and empty words are left out; other columns are not read; an empty table gives an empty table.
    ``ratio`` is above 1, which keeps chains of forms free of circles.
    """
    if ratio <= 1:
        raise ValueError("the ratio of a form to its variant must be above 1")
    distinct = saved(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    placed = places(distinct)
    near = saved(near_words(placed))
    known = placed.select("id", "word", "n")
    joined = known.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("form_n") >= ratio * F.col("n"), F.struct("form", "form_n")).alias("f"))
    rows = saved(joined.select("id", "word", "n", "n_near", "f.form", "f.form_n"))
    changed = rows.where("form is not null")
    names = known.select(F.col("id").alias("name_id"), F.col("word").alias("name"))
    ends = last_forms(changed).join(names, F.col("root") == F.col("name_id")).select("id", F.col("name").alias("last"))
    named = changed.select("id", "form").join(names, F.col("form") == F.col("name_id")).select(
        "id", F.col("name").alias("form_word")).join(ends, "id")
    return rows.join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("last", "word").alias("root"), "n",
        F.col("n_near").cast("long").alias("n_near"), "form_n")
