"""Document fingerprints by SpotSigs, in DataFrame functions only.

Texts are lower-cased and stripped of punctuation. Common words (anchors) are
joined to the word that follows them; a spot signature is a hash of the
anchors, the content word after them and the next content word. Stretches of
``STRETCH`` words that hold no anchor use all their words as anchors, so every
text of a word or more has a signature. A fingerprint is the sorted set of
signatures; likeness is the Jaccard coefficient of two of them.

:func:`near_pairs` finds similar fingerprints: sets are partitioned by length
so that only neighbouring partitions can be similar, inside which only sets
that share one of their rarest signatures are compared, and lengths prune
those first.

Defined results: null, empty and punctuation-only texts have the empty
fingerprint; two empty fingerprints are alike (1), an empty and another one
not (0). The next document of the largest doc_id is the smallest. Rows of one
doc_id share their neighbour; where the next id has several rows, the one with
the smallest beginning counts. Rows without doc_id have no neighbour: nothing
replaces the end of their text and near_next is 0. Empty tables give no rows;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Common words of four languages.
ANCHORS = (
    "the of and to a in is it that for was as with be by are this on at from an "
    "der die das und den von zu mit ist ein eine im für auf dem des sich nicht auch "
    "le la les de des et un une est que pour dans qui par pas sur du en "
    "el los las una y se no con del al para su lo").split()
STRETCH = 32
_JOIN = "\x01"
_STRIP = ".,;:!?\"'()[]{}<>|&$%#*+=/\\-_@~^`\x01"
_BLANK = "\t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body
    uses it: a lambda variable cannot be replaced by its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column) -> Column:
    """Sorted distinct spot signatures of a text."""
    words = "|".join(sorted(set(ANCHORS), key=lambda w: (w[0], -len(w))))
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _BLANK + _STRIP, " " * len(_BLANK))
    joined = F.regexp_replace(F.trim(plain), f"(?<![^ ])({words}) +(?=[^ ])", f"$1{_JOIN}")
    has = lambda e: F.instr(e, _JOIN) > 0

    def stretches(w):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / STRETCH).cast("int")),
                           lambda b: F.exists(F.slice(w, b * STRETCH + 1, F.lit(STRETCH)), has))

    def spots(w):
        return _let(stretches(w), lambda s: F.transform(w, lambda e, i: F.when(
            has(e) | ~F.get(s, F.shiftright(i, 5)), F.hash(e, F.substring_index(F.get(w, i + 1), _JOIN, -1)))))

    found = _let(F.split(joined, " +"), lambda w: F.array_distinct(F.filter(spots(w), lambda x: x.isNotNull())))
    # The only word of a blank text is the empty one.
    return F.when(F.length(F.trim(plain)) > 0, F.sort_array(found)).otherwise(F.array().cast("array<int>"))


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the array column ``name`` of :func:`signatures`."""
    return df.withColumn(name, signatures(text))


def fingerprint(signatures: Column) -> Column:
    return F.concat_ws(",", signatures.cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
            .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(both / (F.size(a) + F.size(b) - both)))


def _neighbours(rows: DataFrame) -> DataFrame:
    """doc_id, need, next_id of every distinct id. Ids are dealt by range; a
    partition's last id takes the first of the next one from a table of one
    row per partition (which is why that may be broadcast)."""
    ids = rows.groupBy("doc_id").agg(F.max("need").alias("need"))
    ids = materialise(ids.repartitionByRange("doc_id").select("doc_id", "need", F.spark_partition_id().alias("part")), "spot-ids")
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(
        F.lead("first").over(order),
        F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    own = ids.withColumn("next", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return own.join(F.broadcast(following), "part").select("doc_id", "need", F.coalesce("next", "after").alias("next_id"))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; see the module's text. Texts are shuffled once, by
    id (both joins use that exchange), and the beginnings that replace the
    ends once."""
    named = lambda df: df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain, no_id = docs.select(id_col, text_col), F.col(id_col).isNull()
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    wanted = materialise(_neighbours(named(plain.where(~no_id)).select("doc_id", quarter.alias("need"))), "spot-next")
    # Dealt by hand, below every new name: so both joins see one exchange.
    known = named(plain.where(~no_id).repartition(id_col))
    wanted = wanted.select(F.col("doc_id").alias("for_id"), "need", "next_id")
    # Signatures are worked out behind the exchange of the texts: one made of
    # plain columns can be used again, and is smaller.
    heads = with_signatures(known.join(wanted, F.col("doc_id") == F.col("next_id")), F.col("text"), "next_sigs")
    heads = (heads.select("for_id", F.struct(F.expr("substring(text, 1, need)").alias("head"), "next_sigs").alias("x"))
             .groupBy("for_id").agg(F.min("x").alias("x")).select("for_id", "x.head", "x.next_sigs"))
    both = known.join(heads, F.col("doc_id") == F.col("for_id")).select("doc_id", "text", "head", "next_sigs")
    alone = named(plain.where(no_id)).select(
        "doc_id", "text", F.lit("").alias("head"), F.lit(None).cast("array<int>").alias("next_sigs"))
    both = with_signatures(both.unionByName(alone), F.col("text"), "sigs")
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))")
    edited = F.concat(kept, F.expr("substring(head, 1, cast(floor(char_length(text) / 4) as int))"))
    both = both.withColumn("edited", edited)
    both = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sigs", "next_sigs", "edited")
    both = with_signatures(both, F.col("edited"), "edited_sigs")
    return both.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        F.coalesce(likeness(F.col("sigs"), F.col("next_sigs")), F.lit(0.0)).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness) of representatives a < b with a likeness of at least
    ``threshold``, and (a, a, 1) for every representative of documents with
    equal fingerprints: the members carry ``representative`` in
    :func:`classes`. Empty fingerprints are like nothing."""
    sets = classes(docs, id_col, text_col).where("representative = doc_id and size(sigs) > 0").select("doc_id", "sigs").dropDuplicates(["doc_id"])
    sets = materialise(sets, "spot-sets")
    spots = sets.select("doc_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = spots.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    # A similar set shares one of the n - ceil(threshold * n) + 1 rarest.
    rare = (spots.join(often, "sig").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
            .select("doc_id", "n", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("x"))
            .select("doc_id", "n", F.col("x.sig").alias("sig")))
    # Partition k holds sizes in [1/threshold^k, 1/threshold^(k+1)): similar
    # sets lie in the same partition or in neighbouring ones.
    part = F.floor(F.log(float(1 / threshold), F.col("n")) + F.lit(1e-9))
    rare = rare.withColumn("part", part)
    left = rare.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = rare.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    pairs = (left.join(right, ["part", "sig"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
             .select("a", "b").distinct())
    found = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("x")), "a")
             .join(sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("y")), "b")
             .select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold))
    return found.unionByName(sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sigs, representative (smallest id with the same fingerprint)."""
    signed = with_signatures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), "sigs").drop("text")
    signed = materialise(signed.withColumn("key", F.md5(fingerprint(F.col("sigs")))), "spot-signed")
    least = materialise(signed.groupBy("key").agg(F.min("doc_id").alias("representative")), "spot-classes")
    return signed.join(least, "key").drop("key")
