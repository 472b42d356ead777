"""Replacement and precedence over a document's sections, and what they mean for a finding's quotes.

sections: doc_id, ordinal, number, heading, text. Statements are read section by section; where the replaced text stands,
which part a section is in and which quotes a statement touches are joins: equal clause numbers and terms, and intervals
by cells. No document is gathered in one task, but for its headings' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import statements as reading
from lexquarry.functions.typed_values import values_in

from .distinct import by_distinct
from .intervals import overlap_join

_READ = (
    "found array<struct<kind:string,start:int,stop:int,target:string,new_start:int,new_stop:int,scope:string,starts:array<string>,unread:boolean,parts:array<string>>>, part string"
)


def _read(text: str | None, heading: str | None):
    found = []
    for s in reading.statements_in(text):
        a, b = s.wording or (None, None)
        parts = [p for named in s.parts for p in reading.ranked_part(named)]
        found.append({"kind": s.kind, "start": s.start, "stop": s.stop, "target": s.target, "new_start": a, "new_stop": b, "scope": s.scope, "starts": list(s.starts), "unread": s.unread, "parts": parts})
    return found, reading.part_of_heading(heading)


def parts_of(sections: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id, ordinal, part: the part that the nearest heading before, or its own, opens; body before the first."""
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return read.select("doc_id", "ordinal", F.coalesce(F.last("part", ignorenulls=True).over(order), F.lit("body")).alias("part"))


def relations(sections: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(relations, parts). relations: doc_id, at (section), start, stop, kind, target, scope, effective, old_at, old_start, old_stop,
    new_start, new_stop, parts.

    A replacement's old text is the other section with the number it names (the first of several). A definition in an
    amendment replaces the body's own of that term, where the body has one. A start not reached on as_of, or one that
    names no date, is a limit like those that are written.
    """
    read = by_distinct(sections, ["doc_id", "ordinal"], ["text", "heading"], _READ, _read)
    parts = parts_of(sections, read)
    every = read.select("doc_id", F.col("ordinal").alias("at"), F.explode("found").alias("s")).select("doc_id", "at", "s.*")
    latest = F.array_max(F.filter("starts", lambda d: d <= F.date_format(as_of, "yyyy-MM-dd")))
    waits = F.filter("starts", lambda d: d > F.date_format(as_of, "yyyy-MM-dd"))
    scope = F.concat_ws("; ", "scope", F.when(F.size(waits) > 0, F.concat(F.lit("from "), F.array_join(waits, ", "))), F.when(F.col("unread"), F.lit("from a start not read")))
    every = every.withColumn("scope", F.when(scope != "", scope)).withColumn("effective", latest).drop("starts", "unread")
    columns = ["doc_id", "at", "start", "stop", "kind", "target", "scope", "effective", "old_at", "old_start", "old_stop", "new_start", "new_stop", "parts"]
    owned = sections.where("number <> ''").select("doc_id", F.col("number").alias("target"), F.col("ordinal").alias("old_at"), F.lit(0).alias("old_start"), F.length(F.coalesce("text", F.lit(""))).alias("old_stop"))
    named = every.where("kind = 'replaces'").alias("s")
    hits = named.join(owned, ["doc_id", "target"]).where("at <> old_at").groupBy("doc_id", "at", "start").agg(F.min(F.struct("old_at", "old_start", "old_stop")).alias("o")).select("doc_id", "at", "start", "o.*")
    replaced = every.where("kind = 'replaces'").join(hits, ["doc_id", "at", "start"], "left").select(columns)
    placed = every.where("kind = 'defines'").join(parts.withColumnRenamed("ordinal", "at"), ["doc_id", "at"])
    body = placed.where("part <> 'amendment'").groupBy("doc_id", "target").agg(F.min(F.struct(F.col("at").alias("old_at"), F.col("new_start").alias("old_start"), F.col("new_stop").alias("old_stop"))).alias("o"))
    fresh = placed.where("part = 'amendment'").join(body, ["doc_id", "target"]).select("*", "o.*").withColumn("kind", F.lit("replaces")).select(columns)
    none = F.lit(None).cast("int")
    ranks = every.where("kind = 'precedence'").select(*[none.alias(c) if c in ("old_at", "old_start", "old_stop") else F.col(c) for c in columns])
    return replaced.unionByName(fresh).unionByName(ranks), parts


def _keys(text: str | None):
    return (sorted({v.key for v in values_in(text or "", True)}),)


def assess(sections: DataFrame, found: DataFrame, parts: DataFrame, findings: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, finding_id, at, start, effect: what each relation means for each finding that it touches.

    findings: doc_id, finding_id, question, answer, observed. spans: doc_id, finding_id, ordinal, a, b (verified quotes).
    Effects, the first that holds: scoped (old text, within a limit), context (the question asks about the original, the
    limit covers only new text, or the change is shown or followed), dated (a time is named), old_value (the new text is
    quoted but the value given is only the old text's), replaced. precedence: quotes that no replacement explains come from
    several parts, all of which the statement ranks.
    """
    key = ["doc_id", "at", "start"]
    changes = found.where("kind = 'replaces'")
    side = lambda where, a, b, name: changes.where(f"{a} IS NOT NULL AND {where} IS NOT NULL").select(*key, F.col(where).alias("ordinal"), F.col(a).alias("p"), F.col(b).alias("q"), F.lit(name).alias("side"))
    passages = side("old_at", "old_start", "old_stop", "old").unionByName(side("at", "new_start", "new_stop", "new"))
    touched = overlap_join(spans.select("doc_id", "finding_id", "ordinal", "a", "b"), passages, ["doc_id", "ordinal"], ("a", "b"), ("p", "q"))
    sides = touched.groupBy("finding_id", *key).agg(F.max(F.col("side") == "old").alias("old"), F.max(F.col("side") == "new").alias("new"))
    cut = passages.join(sections.select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"]).select(*key, "side", F.expr("substring(text, p + 1, q - p)").alias("t"))
    values = by_distinct(cut, [*key, "side"], ["t"], "keys array<string>", _keys)
    empty = F.array().cast("array<string>")
    per = values.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("keys"))), empty).alias(s + "_keys") for s in ("old", "new")])
    per = per.select(*key, F.array_except("new_keys", "old_keys").alias("only_new"), F.array_except("old_keys", "new_keys").alias("only_old"))
    read = lambda q, answer, observed: (reading.perspective(q), *_keys(answer), *_keys(observed))
    asked = by_distinct(findings, ["doc_id", "finding_id"], ["question", "answer", "observed"], "asks string, said array<string>, position array<string>", read)
    rows = sides.join(changes.select(*key, "scope"), key).join(per, key).join(asked, ["doc_id", "finding_id"])
    differs = F.array_union("only_new", "only_old")
    stance = F.when(F.size(F.array_intersect("position", differs)) > 0, F.col("position")).otherwise(F.col("said"))
    new_said, old_said = (F.size(F.array_intersect(stance, F.col(c))) > 0 for c in ("only_new", "only_old"))
    effect = (
        F.when(F.col("old") & F.col("scope").isNotNull(), "scoped")
        .when((F.col("asks") == "historical") | F.col("scope").isNotNull(), "context")
        .when(F.col("asks") == "dated", "dated")
        .when(F.col("new") & old_said & ~new_said, "old_value")
        .when(~F.col("old") | F.col("new") | new_said, "context")
        .otherwise("replaced")
    )
    changed = rows.select("doc_id", "finding_id", "at", "start", effect.alias("effect"))
    explained = touched.select("doc_id", "finding_id", "ordinal", "a", "b").distinct()
    free = spans.select("doc_id", "finding_id", "ordinal", "a", "b").join(explained, ["doc_id", "finding_id", "ordinal", "a", "b"], "left_anti").join(parts, ["doc_id", "ordinal"])
    involved = free.groupBy("doc_id", "finding_id").agg(F.collect_set("part").alias("involved")).where(F.size("involved") > 1)
    ranks = found.where("kind = 'precedence'").select(*key, F.col("parts").alias("ranked"))
    both = involved.join(ranks, "doc_id")
    all_ranked = F.forall("involved", lambda p: F.array_contains("ranked", p) | F.array_contains("ranked", F.concat(F.split(p, " ")[0], F.lit(" *"))))
    return changed.unionByName(both.where(all_ranked).select("doc_id", "finding_id", "at", "start", F.lit("precedence").alias("effect")))
