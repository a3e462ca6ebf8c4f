"""What property accesses mean across files: values are rewritten step by step by joins, until a method or nothing is found.

A value (`sources.typed`) is a base with steps.  Rules say what a base and its first step become: names of a file (declarations,
imports), exports (own, passed on by name, passed on by *), members of classes, and the class above.  A round joins all open
values with the rules once, and once more those that miss with the fallbacks (* exports, the class above); a value ends when its
last step names a method, or when nothing is known about it.  Rounds follow the longest chain of a value, not the number of
files; equal values are rewritten once, whoever holds them, so a service that a third of all files uses is one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.operators import graph
from corvane.operators.session import checkpointing

#: A value with more steps describes itself by itself without end; so does one that is open after so many rounds.
STEPS, ROUNDS = 64, 200


def aliased(specs: DataFrame, base_url: str | None = None, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """file_path, spec, as_spec: specifiers as relative ones; those that match a pattern of `paths` (at most one *, the longest
    prefix first, its first target) or, with a base_url, any that isn't relative, are taken from the root."""
    up = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.size(F.split("file_path", "/")) - 1))
    root = (base_url or "").strip("./")
    join = lambda *p: F.concat(up, *[F.lit(x) if isinstance(x, str) else x for x in p])
    under = f"{root}/" if root else ""
    spec, out = F.col("spec"), F.lit(None)
    if base_url is not None:
        out = join(under, spec)
    for pattern in sorted(paths or {}, key=lambda p: (len(p.split("*")[0]), "*" not in p)):  # later ones are tried first
        head, star, tail = pattern.partition("*")
        to_head, _, to_tail = ((paths or {})[pattern] or [""])[0].partition("*")
        to_head = to_head.removeprefix("./")
        if star:
            hit = spec.startswith(head) & spec.endswith(tail) & (F.length(spec) >= len(head) + len(tail))
            out = F.when(hit, join(under, to_head, F.substring(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail)), to_tail)).otherwise(out)
        else:
            out = F.when(spec == pattern, join(under, to_head)).otherwise(out)
    return specs.withColumn("as_spec", F.when(spec.startswith("."), spec).otherwise(out))


def _targets(facts: DataFrame, nodes: DataFrame, base_url: str | None, paths: dict[str, list[str]] | None) -> DataFrame:
    specs = aliased(facts.where("kind in ('import', 'export') and spec is not null").select("file_path", "spec").distinct(), base_url, paths).where("as_spec is not null")
    hit = graph.resolved(specs.select("file_path", F.col("as_spec").alias("spec")), nodes, dotted=True)
    return specs.join(hit.select(F.col("src").alias("file_path"), F.col("spec").alias("as_spec"), "dst"), ["file_path", "as_spec"]).select("file_path", "spec", "dst")


def cancelled(steps: Column) -> Column:
    """Steps without neighbours that undo each other: wx, x, and new, wnew."""
    top = lambda a: F.element_at(a, -1)
    undo = lambda a, s: (F.size(a) > 0) & ((top(a) == F.concat(F.lit("w"), s)) | (top(a) == "new") & (s == "wnew"))
    return F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(undo(a, s), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(s))))


def rules(facts: DataFrame, nodes: DataFrame, base_url: str | None = None, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """rule, k1, k2 and what such a value becomes: base, file, of, steps, target (a method's id)."""
    to = _targets(facts, nodes, base_url, paths)
    none, no_steps = F.lit(None).cast("string"), F.array().cast("array<string>")
    f, name, other = F.col("file_path"), F.col("name"), F.col("other")
    become = lambda base, file, of, steps=no_steps: F.struct(base.alias("base"), file.alias("file"), of.alias("of"), steps.alias("steps"))
    own = F.when(F.col("base").isNotNull(), become(F.col("base"), f, F.col("of"), F.col("steps")))
    row = lambda df, rule, k1, k2, become, first=0, target=none: df.select(F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), k1.alias("k1"), k2.alias("k2"), F.struct(F.lit(first).alias("p"), F.col("ord")).alias("at"), become.alias("v"), target.alias("target"))
    there = facts.where("kind in ('import', 'export')").join(to, ["file_path", "spec"])
    passed = F.when(other == "*", become(F.lit("module"), F.col("dst"), F.lit(""))).otherwise(become(F.lit("export"), F.col("dst"), other))
    method = F.concat(F.lit("method:"), F.regexp_replace("cls", r"@\d+$", ""), F.lit("."), name, F.lit("@"), F.col("line"))
    members = facts.where("kind = 'member'")
    unique = [
        row(facts.where("kind = 'decl'"), "n", f, name, own),
        row(there.where("kind = 'import'"), "n", f, name, passed, 1),
        row(facts.where("kind = 'export' and spec is null"), "e", f, name, become(F.lit("name"), f, other)),
        row(there.where("kind = 'export' and name <> '*'"), "e", f, name, passed, 1),
        row(members.where("base is not null"), F.when(F.col("static"), "M").otherwise("m"), F.col("cls"), name, own),
        row(members, F.when(F.col("static"), "M").otherwise("m"), F.col("cls"), name, F.lit(None).cast("struct<base:string,file:string,of:string,steps:array<string>>"), 2, F.when(other == "method", method)),
        row(facts.where("kind = 'class' and base is not null"), "p", F.col("cls"), F.lit(""), own),
    ]
    stars = row(there.where("kind = 'export' and name = '*'"), "s", f, F.lit(""), become(F.lit("export"), F.col("dst"), none)).distinct()
    all_ = unique[0]
    for u in unique[1:]:
        all_ = all_.unionByName(u)
    one = all_.groupBy("rule", "k1", "k2").agg(F.min_by("v", "at").alias("v"), F.min("target").alias("target"))
    return one.unionByName(stars.select("rule", "k1", "k2", "v", "target")).select("rule", "k1", "k2", "v.base", "v.file", "v.of", "v.steps", "target")


def targets(values: DataFrame, by: DataFrame) -> DataFrame:
    """origin, target of values (origin, base, file, of, steps); the last step, !m, asks for a method m.  Values that lead to no
    method, or to several (names that two * exports give), have no row."""
    checkpointing(values.sparkSession)
    by = by.checkpoint()
    r = by.select("rule", "k1", "k2", *[F.col(c).alias(f"to_{c}") for c in ("base", "file", "of", "steps")], "target", F.lit(True).alias("found"))
    main = r.where("rule not in ('s', 'p')")
    rest = r.where("rule in ('s', 'p')").select(F.col("rule").alias("other"), "k1", *[F.col(f"to_{c}").alias(f"or_{c}") for c in ("base", "file", "of", "steps")])
    state = ["origin", "base", "file", "of", "steps", "seen"]
    first = lambda: F.try_element_at("steps", F.lit(1))
    tail = F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0)))
    open_ = values.select("origin", "base", "file", "of", cancelled(F.col("steps")).alias("steps"), F.array().cast("array<long>").alias("seen")).checkpoint()
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        # a class that is made is an instance; an instance that is awaited stays; a name of a module is an export
        new, wait, out = (F.col("base") == "static") & (first() == "new"), (F.col("base") == "class") & (first() == "await"), (F.col("base") == "module") & first().startswith(".")
        s = open_.select("origin", F.when(new, "class").when(out, "export").otherwise(F.col("base")).alias("base"), "file", F.when(out, F.substring(first(), F.lit(2), F.length(first()))).otherwise(F.col("of")).alias("of"), F.when(new | wait | out, tail).otherwise(F.col("steps")).alias("steps"), "seen")
        # a module that ends in a wanted method is an export as well, but of a function: nothing
        mark = F.xxhash64("base", "file", "of", F.array_join("steps", "\n"))
        s = s.where((F.size("steps") <= STEPS) & ~F.array_contains("seen", mark)).withColumn("seen", F.concat("seen", F.array(mark)))
        up = (F.col("base").isin("class", "static")) & (first() == "^")
        s = s.withColumn("up", up)
        asks = first().startswith(".") | first().startswith("!")
        rule = F.when(up, None).when(F.col("base") == "name", "n").when(F.col("base") == "export", "e").when((F.col("base") == "class") & asks, "m").when((F.col("base") == "static") & asks, "M")
        named = F.col("base").isin("name", "export")
        s = s.withColumn("rule", rule).withColumn("k1", F.when(named, F.col("file")).otherwise(F.col("of"))).withColumn("k2", F.when(named, F.col("of")).otherwise(F.substring(first(), F.lit(2), F.length(first()))))
        j = s.where("rule is not null or up").join(main, ["rule", "k1", "k2"], "left")
        other = F.when(F.col("found"), None).when((F.col("rule") == "e") & (F.col("k2") != "default"), "s").when(F.col("rule").isin("m", "M") | F.col("up"), "p")
        j = j.withColumn("other", other).join(rest, ["other", "k1"], "left")
        asked = F.coalesce(F.col("found"), F.lit(False)) & ~named & first().startswith("!") & ~F.col("up")
        more = F.when(named, F.col("steps")).otherwise(tail)
        made = F.when(F.col("base") == "class", F.array(F.lit("new"))).otherwise(F.array().cast("array<string>"))
        above = F.when(F.col("other") == "s", F.col("steps")).otherwise(F.concat("or_steps", made, F.when(F.col("up"), tail).otherwise(F.col("steps"))))
        then = lambda c, d: F.when(asked, None).when(F.col("found"), F.col(f"to_{c}")).otherwise(d)
        nxt = j.select(
            "origin", then("base", F.col("or_base")).alias("base"), then("file", F.col("or_file")).alias("file"), then("of", F.coalesce("or_of", "of")).alias("of"),
            cancelled(F.when(F.col("found"), F.concat("to_steps", more)).otherwise(above)).alias("steps"), "seen", F.when(asked, F.col("target")).alias("target"),
        ).where("base is not null or target is not null").checkpoint()
        done.append(nxt.where("target is not null").select("origin", "target"))
        open_ = nxt.where("target is null").select(*state)
        if not open_.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.groupBy("origin").agg(F.min("target").alias("target"), F.max("target").alias("other")).where("target = other").select("origin", "target")


def references(facts: DataFrame, nodes: DataFrame, base_url: str | None = None, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """method_id, file_path, line, col of every property access that means a method of a named class."""
    asked = F.concat("steps", F.array(F.concat(F.lit("!"), "name")))
    # a class or an instance means the same in every file
    file = F.when(F.col("base").isin("class", "static"), "").otherwise(F.col("file_path"))
    # a name that no class has as a method means none
    known = facts.where("kind = 'member' and other = 'method'").select("name").distinct()
    refs = facts.where("kind = 'ref'").join(known, "name", "left_semi").select("file_path", "line", "col", "base", file.alias("file"), "of", asked.alias("steps"))
    refs = refs.withColumn("origin", F.sha2(F.to_json(F.struct("base", "file", "of", "steps")), 256))
    values = refs.groupBy("origin").agg(*[F.first(c).alias(c) for c in ("base", "file", "of", "steps")])
    found = targets(values, rules(facts, nodes, base_url, paths))
    return refs.join(found, "origin").select(F.col("target").alias("method_id"), "file_path", "line", "col")
