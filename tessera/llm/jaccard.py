"""Exact n-gram Jaccard join by parity sketches.

A document's set are its distinct shingles of five words (A-Z lower-cased). Equal sets are one node.
In a size band, sets are dealt into p buckets by hash and the tokens of a bucket are XORed into one
word. A token that only one of two sets has changes one word at most, so sets that differ in d tokens
agree in all but d words; sets with a Jaccard index of 80 % or more differ in at most d = a quarter of
the smaller set, and p exceeds that bound by reserves. A node that enters e words must therefore share
e - d of them with any true partner. Nodes that share fewer leave, and of its shared words each node
keeps only the rarest, as many as it must to keep one in common with every partner: the words of the
largest groups fall away first. A second sketch of 512 bits, one flipped by each token, gives a lower
bound of the difference as its Hamming distance and drops pairs before their sets are compared.

Groups are not expanded into pairs. Every word draws a leader from its group, other ones for other
words, and each node is compared with the nearest of its leaders by Hamming distance. Only members that
are still in different components after that are paired, under the size and Hamming filters. Every link
that joins two components is compared exactly, and none between components is left untested.

No word's group is gathered in one task: a task sends a word that it meets often on by its key a few
times only and deals its other rows over lots, as all of them are known to be shared (such words count
as the most common ones in the order by rarity); later steps over groups are partial aggregates and
joins, which adaptive execution splits.

Defined cases: fewer than five words are one shingle; null or empty texts have no shingle, are linked
with nothing and are their own component, whatever else has their key; rows with a null key get a null component and link nothing;
rows that repeat a key are one document with several texts, linked with what any of them is linked to;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, mix64
from tessera.llm.components import EDGES_PER_TASK, components
from tessera.llm.words import Texts, text_batches

SHINGLE = 5
#: Upper bound of a size band over the one before it.
BAND_RATIO = 1.5
#: Leaders that each node is compared with.
LEADERS = 3
#: Rows of one word in a slice of a task that make the word hot there, lots that its further rows are dealt
#: over, and the members that a hot word counts for.
HOT_ROWS, LOTS, HOT = 8, 1 << 16, 1 << 40
HOT_MARK = 1 << 40
SKETCH_WORDS = 8
_LOW = np.uint64((1 << 52) - 1)

SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def size_bands(most: int) -> np.ndarray:
    """Largest set size of each band, up to one that holds ``most``."""
    tops = [3]
    while tops[-1] < most:
        tops.append(int(tops[-1] * BAND_RATIO) + 1)
    return np.array(tops, np.int64)


def buckets_of(top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, difference bound, empty words left out at most) of bands with the given largest sizes.

    The buckets exceed the bound by one, by the empty words and by an eighth for rarity to choose from.
    """
    bound = top // 4
    for_empty = bound // 4 + 1
    return bound + 1 + for_empty + bound // 8 + 1, bound, for_empty


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, document) of each document's distinct shingles, sorted by document, and their bounds.

    Tokens are 52-bit hashes; a batch holds at most 4096 documents.
    """
    hashes, at = texts.windows(SHINGLE)
    doc = texts.doc_of_words()[at]
    for k in range(1, SHINGLE):  # texts of fewer words: the whole sequence
        few = np.flatnonzero(texts.n_words == k)
        if len(few):
            whole = np.full(len(few), np.uint64(k))
            for j in range(k):
                whole = mix64(whole + texts.hashes[texts.first[few] + j], 4)
            hashes, doc = np.append(hashes, whole), np.append(doc, few)
    packed = np.unique((doc.astype(np.uint64) << np.uint64(52)) | (hashes & _LOW))
    doc = (packed >> np.uint64(52)).astype(np.int64)
    return packed & _LOW, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def fingerprints(tokens: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint of each document's set."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, mix64(tokens, 31))
    return mix64(out, 32)


def parity_sketches(tokens: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Each document's 512 bits; every token flips one."""
    out = np.zeros((n, SKETCH_WORDS), np.uint64)
    place = mix64(tokens, 33)
    np.bitwise_xor.at(out, (doc, (place % np.uint64(SKETCH_WORDS)).astype(np.int64)), np.uint64(1) << ((place >> np.uint64(20)) % np.uint64(64)))
    return out


def band_words(tokens: np.ndarray, doc: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, mark) of the words that the chosen documents enter.

    The mark is the band plus 256 times the number of words that a true partner shares at least. A set enters its own band, and the one below if a set of 80 % of its size can lie there.
    """
    sizes = np.diff(first)
    tops = size_bands(int(sizes.max(initial=1)))
    own = np.searchsorted(tops, sizes)
    keys, docs, bands = [], [], []
    for lower in (0, 1):
        band = own - lower
        enters = chosen & (sizes > 0) & (band >= 0)
        if lower:
            enters &= 4 * sizes <= 5 * tops[np.maximum(band, 0)]
        who = np.flatnonzero(enters)
        if not len(who):
            continue
        p, bound, for_empty = buckets_of(tops[band[who]])
        base = np.cumsum(p) - p
        row_of = np.full(len(sizes), -1)
        row_of[who] = np.arange(len(who))
        row = row_of[doc]
        mine = row >= 0
        row, token = row[mine], tokens[mine]
        words = np.zeros(int(p.sum()), np.uint64)
        bucket = (mix64(token, 34) % p[row].astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(words, base[row] + bucket, mix64(token, 35))
        of = np.repeat(np.arange(len(who)), p)
        empty = words == 0
        n_empty = np.add.reduceat(empty, base)
        out = ~empty | (n_empty > for_empty)[of]
        # Agreeing words less the empty ones that this set, or a partner without too many, does not enter.
        need = p - bound - np.minimum(n_empty, for_empty)
        label = ((np.arange(len(words)) - base[of]) << 8) + band[who][of]
        keys.append(mix64(words ^ mix64(label.astype(np.uint64), 36), 37)[out])
        docs.append(who[of][out])
        bands.append((need * 256 + band[who])[of][out])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(bands)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, sketch words) of every row."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_shingles", "node", *SKETCH)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"), lower=True)
            tokens, doc, first = shingle_sets(texts)
            sketch = parity_sketches(tokens, doc, len(texts))
            columns = [batch.column("doc_id"), pa.array(np.diff(first)), _signed(fingerprints(tokens, doc, len(texts))), *[_signed(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(rows, ", ".join(f"{f.name} long" for f in schema))


def _lots(keys: np.ndarray, nodes: np.ndarray, hot: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lot of each row, hot keys of the task so far): which rows of very common words go apart.

    Of a key that more than ``most`` rows of one slice have, these are sent by key with the mark -1, and
    later rows of the task to lots 1..``LOTS`` by node. Rows of other keys are lot 0.
    """
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    place = np.arange(len(keys)) - np.repeat(first, size)
    known = np.isin(ordered[first], hot)
    new = ~known & (size > most)
    of_new, of_known = np.repeat(new, size), np.repeat(known, size)
    lot = np.where(of_known | (of_new & (place >= most)), 1 + (mix64(nodes[order], 38) % np.uint64(LOTS)).astype(np.int32), np.where(of_new, -1, 0))
    out = np.zeros(len(keys), np.int32)
    out[order] = lot
    return out, np.union1d(hot, ordered[first[new]]) if new.any() else hot


def word_table(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, node, mark, part) of all sets; a task enters equal sets once.

    Rows of one key and part 0 belong together, with ``HOT_MARK`` set in the mark where the key is hot; a key has at most ``hot_rows`` rows for each slice of a
    task until it is found hot there, its further rows are dealt over lots.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("mark", pa.int64()), ("part", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hot = np.zeros(0, np.uint64)
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"), lower=True)
            tokens, doc, first = shingle_sets(texts)
            node = fingerprints(tokens, doc, len(texts))
            new = np.zeros(len(texts), bool)
            for i, f in enumerate(node.tolist()):
                if f not in seen:
                    seen.add(f)
                    new[i] = True
            keys, who, bands = band_words(tokens, doc, first, new)
            lots, hot = _lots(keys, node[who], hot, hot_rows)
            for i in range(0, len(keys), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([_signed(keys[s]), _signed(node[who[s]]), pa.array(bands[s] | np.where(lots[s] < 0, HOT_MARK, 0)), pa.array(np.maximum(lots[s], 0))], schema=schema)

    return docs.mapInArrow(rows, "key long, node long, mark long, part int")


def token_table(chosen: DataFrame) -> DataFrame:
    """(node, tokens) from ``chosen(node, text)``.

    Texts whose set is not the node's (another row of its document's key) are passed over.
    """
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = Texts(batch.column("text"), lower=True)
            tokens, doc, first = shingle_sets(texts)
            own = fingerprints(tokens, doc, len(texts)).view(np.int64) == np.asarray(batch.column("node"))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _signed(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], schema=schema).filter(pa.array(own))

    return chosen.select("node", "text").mapInArrow(rows, "node long, tokens array<long>")


def _hamming(a: str, b: str) -> Column:
    """Bits in which the sketches of two struct columns differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH])


def _near(a: str, b: str) -> Column:
    """The size and Hamming filters on two struct columns; no true link fails them."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * _hamming(a, b) <= na + nb)


class Join:
    """The join's steps over one table of documents."""

    def __init__(self, docs: DataFrame, hot_rows: int = HOT_ROWS, edges_per_task: int = EDGES_PER_TASK):
        self.hot_rows, self.edges_per_task = hot_rows, edges_per_task
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = self.scratch.keep(set_table(self.docs), "rows")

    def nodes(self) -> DataFrame:
        """(node, rep, of(rep, n, sketch)) of the different sets; ``rep`` is the least document that has the set."""
        known = self.rows.where("doc_id is not null and n_shingles > 0")
        least = known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), *[F.min(s).alias(s) for s in SKETCH])
        return least.select("node", "rep", F.struct("rep", "n", *SKETCH).alias("of"))

    def groups(self) -> DataFrame:
        """(key, node, of): the words that nodes share and need to meet every partner."""
        words = word_table(self.docs.where("doc_id is not null"), self.hot_rows)
        by_key = Window.partitionBy("key", "part")
        hot = (F.col("part") > 0) | (F.max("mark").over(by_key) >= HOT_MARK)
        members = F.when(hot, HOT).otherwise(F.count(F.lit(1)).over(by_key))
        met = words.select("key", "part", "node", "mark", members.alias("members"), F.min("node").over(by_key).alias("low"), F.max("node").over(by_key).alias("high"))
        mark = F.col("mark").bitwiseAND(HOT_MARK - 1).alias("mark")
        shared = met.where("part > 0 or low < high").select("key", "part", "node", mark, "members").distinct().select("key", "node", "mark", "members")
        own = Window.partitionBy("node", "mark")
        need = F.floor(F.col("mark") / 256)
        ranked = shared.repartition("node").select("*", F.count(F.lit(1)).over(own).alias("shared"), F.row_number().over(own.orderBy("members", "key")).alias("place"))
        needed = ranked.where((F.col("shared") >= need) & (F.col("place") <= F.col("shared") - need + 1)).select("key", "node")
        return needed.join(self.nodes().select("node", "of"), "node").select("key", "node", "of")

    @staticmethod
    def _nearest_leaders(groups: DataFrame) -> DataFrame:
        """(a, b, ca, cb): for each node b the nearest leaders a of its groups, ``LEADERS`` at most, with both reps."""
        draw = F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node", "of")).alias("lead")
        leads = groups.groupBy("key").agg(draw, F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        sides = groups.join(leads.select("key", "lead"), "key").select(F.col("lead.node").alias("a"), F.col("lead.of").alias("a_"), F.col("node").alias("b"), F.col("of").alias("b_"))
        near = sides.where((F.col("a") != F.col("b")) & _near("a_", "b_"))
        to = F.struct((_hamming("a_", "b_") / (F.col("a_.n") + F.col("b_.n"))).alias("apart"), "a", F.col("a_.rep").alias("ca"))
        some = near.groupBy("b").agg(F.min("b_.rep").alias("cb"), F.slice(F.array_sort(F.collect_set(to)), 1, LEADERS).alias("to"))
        return some.select("b", "cb", F.explode("to").alias("to")).select("to.a", "b", "to.ca", "cb")

    def _tokens(self, groups: DataFrame) -> DataFrame:
        """The token sets of all grouped nodes, made again from one text of each."""
        reps = groups.groupBy("node").agg(F.min("of.rep").alias("doc_id"))
        return token_table(self.docs.join(reps, "doc_id"))

    @staticmethod
    def _links(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """(a, b): what stands for both ends (``ca``, ``cb``) of the true links among ``pairs(a, b, ca, cb)``."""
        sides = pairs
        for c in "ba":
            sides = sides.join(tokens.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}")), c)
        common = F.size(F.array_intersect("ta", "tb"))
        return sides.where(100 * common >= 80 * (F.size("ta") + F.size("tb") - common)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    def _open_pairs(self, groups: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs (a, b, ca, cb) of one group that pass the filters and lie in two components, ca and cb."""
        of = groups.select("key", "node", "of", F.col("of.rep").alias("rep")).join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        member = of.select("key", "node", F.coalesce("component", "rep").alias("component"), "of")
        split = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        apart = self.scratch.keep(member.join(split, "key"), "apart")
        x, y = (apart.select("key", F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("of").alias(f"{c}_")) for c in "ab")
        pairs = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near("a_", "b_"))
        return pairs.select("a", "b", "ca", "cb").distinct()

    def _repeated(self) -> DataFrame:
        """(a, b): least documents of the sets of documents that have several."""
        rows = self.rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "node")
        several = rows.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc_id")
        return rows.join(several, "doc_id").distinct().join(self.nodes().select("node", "rep"), "node").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    def document_components(self) -> DataFrame:
        """(node, component) of the least documents of sets that have a link; the component is the least of them."""
        scratch = self.scratch
        groups = scratch.keep(self.groups(), "groups")
        scratch.release()
        first = scratch.keep(self._nearest_leaders(groups), "leaders")
        scratch.release()
        tokens = scratch.keep(self._tokens(groups), "tokens")
        scratch.release()
        found = components(self._links(first, tokens).union(self._repeated()), scratch, self.edges_per_task)
        more = self._links(self._open_pairs(groups, found), tokens)
        return components(more.union(found.select(F.col("component").alias("a"), F.col("node").alias("b"))), scratch, self.edges_per_task)

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        found = self.document_components()
        least = self.nodes().select("node", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        # written, so that adaptive execution can split the rows of a set that many documents have
        by_node = self.scratch.keep(least.select("node", F.coalesce("component", "rep").alias("least")), "components")
        self.scratch.only(self.rows, by_node)
        self.scratch.release()
        own = F.when(F.col("n_shingles") > 0, F.col("node"))
        rows = self.rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("node"))
        return rows.join(by_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``."""
    return Join(docs).result()


#: The same by comparing all pairs that share a shingle; for small tables.
SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as i from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all
), links as (
  select a, b from pairs join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b where 100 * i >= 80 * (sa.n + sb.n - i)
), edges as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union select reach.a, edges.b from reach join edges on reach.b = edges.a
)
select documents.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)
"""
