"""Replay of a batch of edit requests of a library's layout, in their order, with what became of each.

An edit is (seq, kind, root, path, document_id), kind one of create, remove (folders), place, clear, delete (documents). Placements never fail, so
where a document is at any time follows from its own edits; that is worked out by windows and joins for all documents at once. Whether a folder
can be made or removed depends on the folders that are there when its turn comes: folder edits alone, each with whether a document was placed at or under its path at
that time, are folded in order, root by root, as a stream: a task holds the folders of one root, and there can't be more than the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.ship import ship

MOST_FOLDERS = 5000
_FOLDED = "root string, path string, seq long, outcome string"


def above(path: Column) -> Column:
    """A path and the folders above it; the empty path has only itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def stays(edits: DataFrame, placements: DataFrame) -> DataFrame:
    """(document_id, root, path, since, until) of every placement there was: until is null for those that last; placements (document_id, root, path) are there first."""
    own = edits.where("kind IN ('place', 'clear', 'delete')").select("document_id", "seq", "kind", "root", "path")
    rows = placements.select("document_id", F.lit(-1).cast("long").alias("seq"), F.lit("place").alias("kind"), "root", "path").unionByName(own)
    until = F.lead("seq").over(Window.partitionBy("document_id").orderBy("seq"))
    return rows.withColumn("until", until).where("kind = 'place'").select("document_id", "root", "path", F.col("seq").alias("since"), "until")


def placed_under(removals: DataFrame, stayed: DataFrame) -> DataFrame:
    """seq of removals (seq, root, path) at whose time a document is placed at the path or under it: begun and ended stays are counted up to
    it, on paths that are to be removed alone."""
    asked = removals.select("root", "path").distinct()
    each = stayed.select("root", F.explode(above(F.col("path"))).alias("path"), "since", "until").join(asked, ["root", "path"])
    steps = each.select("root", "path", F.col("since").alias("at"), F.lit(1).alias("n")).unionByName(each.where("until IS NOT NULL").select("root", "path", F.col("until").alias("at"), F.lit(-1).alias("n")))
    sums = steps.groupBy("root", "path", "at").agg(F.sum("n").alias("n")).withColumn("seq", F.lit(None).cast("long"))
    both = sums.unionByName(removals.select("root", "path", F.col("seq").alias("at"), F.lit(0).cast("long").alias("n"), "seq"))
    now = F.sum("n").over(Window.partitionBy("root", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("now", now).where("seq IS NOT NULL AND now > 0").select("seq")


def _fold(most: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, folders, inside = None, set(), {}  # folders: (root, path); inside: how many folders lie strictly under each

        def change(root: str, path: str, by: int) -> None:
            (folders.add if by > 0 else folders.discard)((root, path))
            parts = path.split("/")
            for n in range(1, len(parts)):
                up = root, "/".join(parts[:n])
                inside[up] = inside.get(up, 0) + by

        def left() -> pd.DataFrame:
            rows = sorted(folders)
            return pd.DataFrame({"root": [r for r, _ in rows], "path": [p for _, p in rows], "seq": pd.Series([None] * len(rows), dtype="Int64"), "outcome": "kept"})

        for batch in batches:
            out = []
            for g, seq, kind, root, path, used in zip(*(batch[c] for c in ("fold", "seq", "kind", "root", "path", "used")), strict=True):
                if g != group:
                    if folders:
                        yield left()
                    group, folders, inside = g, set(), {}
                there = (root, path) in folders
                if kind == "there":
                    if not there:
                        change(root, path, 1)
                    continue
                if kind == "create":
                    outcome = "exists" if there else "full" if len(folders) >= most else "created"
                else:
                    outcome = "absent" if not there else "blocked" if used or inside.get((root, path), 0) else "removed"
                if outcome in ("created", "removed"):
                    change(root, path, 1 if outcome == "created" else -1)
                out.append((root, path, seq, outcome))
            yield pd.DataFrame(out, columns=["root", "path", "seq", "outcome"])
        if folders:
            yield left()

    return fold


def replay(edits: DataFrame, folders: DataFrame, placements: DataFrame, most: int = MOST_FOLDERS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(outcomes: seq, outcome), (folders: root, path), (placements: document_id, root, path) and (deleted: document_id) after edits.

    seq is unique and not negative; edits without one are left out. Outcomes: a folder is created, exists, or the library is full (of most folders); it is removed, absent, or
    blocked by a document placed at or under it or by a folder under it; a document is placed or moved; clear and delete say cleared and deleted, or nothing where there
    was no placement (a deleted document's placement goes with it, and a later edit may place it again). The limit is one of all roots: while folders that are there and those
    that edits name can't be too many, roots are folded apart; else all folder edits are one fold, in their order.
    """
    ship(edits.sparkSession)
    edits = edits.where("seq >= 0")
    asked = edits.where("kind IN ('create', 'remove')").select("seq", "kind", "root", "path")
    named = folders.select("root", "path").unionByName(asked.where("kind = 'create'").select("root", "path")).distinct()
    fold = F.col("root") if named.limit(most + 1).count() <= most else F.lit("")
    stayed = stays(edits, placements)
    used = placed_under(asked.where("kind = 'remove'"), stayed).withColumn("used", F.lit(True))
    rows = asked.join(used, "seq", "left").select("seq", "kind", "root", "path", F.coalesce("used", F.lit(False)).alias("used"))
    first = folders.select(F.lit(-1).cast("long").alias("seq"), F.lit("there").alias("kind"), "root", "path", F.lit(False).alias("used"))
    ordered = first.unionByName(rows).withColumn("fold", fold).repartition("fold").sortWithinPartitions("fold", "seq")
    folded = ordered.select("fold", "seq", "kind", "root", "path", "used").mapInPandas(_fold(most), _FOLDED)
    before = Window.partitionBy("document_id").orderBy("seq")
    own = placements.select("document_id", F.lit(-1).cast("long").alias("seq"), F.lit("place").alias("kind")).unionByName(edits.where("kind IN ('place', 'clear', 'delete')").select("document_id", "seq", "kind"))
    was = F.lag("kind").over(before) == "place"
    said = F.when(F.col("kind") == "place", F.when(was, "moved").otherwise("placed")).when(was, F.concat("kind", F.when(F.col("kind") == "clear", "ed").otherwise("d"))).otherwise("nothing")
    documents = own.withColumn("outcome", F.coalesce(said, F.lit("nothing"))).where("seq >= 0").select("seq", "outcome")
    outcomes = folded.where("seq IS NOT NULL").select("seq", "outcome").unionByName(documents)
    gone = edits.where("kind = 'delete'").select("document_id").distinct()
    return outcomes, folded.where("seq IS NULL").select("root", "path"), stayed.where("until IS NULL").select("document_id", "root", "path"), gone


def cascaded(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of deleted documents."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
