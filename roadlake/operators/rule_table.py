"""Alert rules as a table, for more rules than a predicate each can serve.

A rule is found by one of its tests, its *anchor*: a membership test with the fewest options
if it has any, else a lower bound, else its event type alone. Anchors are an index: options
by event type, key and value, joined by equality; bounds by event type and key in sorted
arrays, of which a value passes a first part, found by halving. All tests are run for the
rules found in this way, and only for those.

Rules and index are dimensions: Spark broadcasts them under its size threshold. An array of
bounds has one entry per rule that is anchored by a bound on that key.

``tallies`` counts the letters of each recipient without writing them. Most rules have at
most one membership test and one lower bound. Events are folded by what such a test looks at
and by how many of the rules' different bounds they pass; sums from the highest bound down
give every rule its letters. Work follows events and rules, not their pairs. Rules with more
tests of a kind go by their letters.

The tests are those of ``alerts.AlertRule`` and give the same answers on both envelope forms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlake.functions.once import once
from roadlake.operators.alerts import ENVELOPE, VALUE, AlertRule, reader

#: ``bound`` of a number's lower bound; else the options, texts and numbers apart.
RULE_SCHEMA = """
    rule_id long, email string, event_types array<string>,
    tests array<struct<key: string, bound: double, texts: array<string>, numbers: array<double>, shown: string>>
"""
#: What the rules of one ladder of bounds have in common.
GROUP = ["event_type", "option_key", "bound_key", "token"]
#: Rules without options look at every event of a type; these meet their ladder in so many parts.
PARTS = 64


def rules_frame(spark: SparkSession, rules: Iterable[AlertRule]) -> DataFrame:
    rows = []
    for number, rule in enumerate(rules):
        tests = []
        for key, threshold in rule.thresholds.items():
            if isinstance(threshold, (int, float)):
                tests.append((key, float(threshold), None, None, str(threshold)))
                continue
            options = threshold if isinstance(threshold, list) else [threshold]
            texts = [o for o in options if isinstance(o, str)]
            numbers = [float(o) for o in options if isinstance(o, (int, float))]
            tests.append((key, None, texts, numbers, str(threshold)))
        rows.append((number, rule.email, list(rule.event_types), tests))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _token(text: Column, number: Column) -> Column:
    """A value as a join key; 0.0 and -0.0 are one number."""
    return F.coalesce(F.concat(F.lit("t"), text), F.concat(F.lit("n"), (number + 0.0).cast("string")))


def _anchored(rules: DataFrame) -> DataFrame:
    """The rules by event type, with their anchor."""
    options = F.filter("tests", lambda t: t["bound"].isNull())
    size = F.transform(
        options,
        lambda t: F.named_struct(
            F.lit("n"), F.size(t["texts"]) + F.size(t["numbers"]), F.lit("test"), t
        ),
    )
    # The fewest options; of tests with as many, the first.
    least = F.array_min(F.transform(size, lambda s: s["n"]))
    best = F.get(F.filter(size, lambda s: s["n"] == least), F.lit(0))["test"]
    anchor = F.coalesce(best, F.get("tests", F.lit(0)))
    of_type = F.explode(F.array_distinct("event_types")).alias("event_type")
    return rules.select("rule_id", of_type, anchor.alias("anchor"))


def _tokens(test: Column) -> Column:
    """The options of a membership test as join keys."""
    return F.array_distinct(
        F.concat(
            F.transform(test["texts"], lambda o: _token(o, F.lit(None).cast("double"))),
            F.transform(test["numbers"], lambda o: _token(F.lit(None).cast("string"), o)),
        )
    )


def _by_option(rules: DataFrame) -> DataFrame:
    anchor = F.col("anchor")
    rows = _anchored(rules).where(anchor.isNotNull() & anchor["bound"].isNull())
    return rows.select("event_type", anchor["key"].alias("key"), F.explode(_tokens(anchor)).alias("token"), "rule_id")


def _by_bound(rules: DataFrame) -> DataFrame:
    anchor = F.col("anchor")
    rows = _anchored(rules).where(anchor["bound"].isNotNull())
    entry = F.struct(anchor["bound"].alias("bound"), "rule_id")
    return _with_steps(
        rows.groupBy("event_type", anchor["key"].alias("key")).agg(
            F.sort_array(F.collect_list(entry)).alias("bounds")
        )
    )


def _with_steps(ladders: DataFrame) -> DataFrame:
    """Add the powers of two, falling, that find a place among the ``bounds``."""
    digits = F.length(F.bin(F.size("bounds")))
    powers = F.transform(F.sequence(digits - 1, F.lit(0), F.lit(-1)), lambda d: F.pow(F.lit(2), d).cast("int"))
    return ladders.withColumn("steps", powers)


def _passed(value: Column) -> Column:
    """How many of the sorted ``bounds`` are not above the value."""

    def climb(place: Column, step: Column) -> Column:
        bound = F.get("bounds", place + step - 1)["bound"]
        return F.when(bound <= value, place + step).otherwise(place)

    return F.aggregate("steps", F.lit(0), climb)


def _holds(test: Column, values: Column) -> Column:
    """Whether the event's value of the test's key passes it; a missing one fails."""

    def passes(value: Column) -> Column:
        is_option = F.when(value["is_text"], F.array_contains(test["texts"], value["text"])).otherwise(
            F.array_contains(test["numbers"], value["plain"])
        )
        # NaN passes a bound, as no number is above it.
        result = F.when(test["bound"].isNotNull(), value["number"] >= test["bound"]).otherwise(is_option)
        return F.coalesce((value["key"] == test["key"]) & result, F.lit(False))

    return F.exists(values, passes)


def candidates(envelopes: DataFrame, rules: DataFrame) -> DataFrame:
    """Envelopes with ``values`` and the ``rule_id`` of each rule whose anchor they pass."""
    data = reader(envelopes)
    keys = sorted(r["key"] for r in rules.select(F.explode("tests.key").alias("key")).distinct().collect())
    values = F.array_compact(F.array(*[data.value(k) for k in keys]).cast(f"array<{VALUE}>"))
    events = once(envelopes, values=values)
    one = events.select("*", F.explode("values").alias("value"))
    one = one.withColumns(
        {"key": F.col("value.key"), "token": _token(F.col("value.text"), F.col("value.plain"))}
    )
    kept = [*envelopes.columns, "values", "rule_id"]
    by_option = one.join(_by_option(rules), ["event_type", "key", "token"]).select(*kept)
    bounded = one.join(_by_bound(rules), ["event_type", "key"])
    passed = F.slice("bounds", F.lit(1), _passed(F.col("value.number")))
    by_bound = bounded.where(F.col("value.number").isNotNull()).withColumn(
        "rule_id", F.explode(F.transform(passed, lambda b: b["rule_id"]))
    )
    free = _anchored(rules).where(F.col("anchor").isNull()).select("event_type", "rule_id")
    of_type = events.join(free, "event_type").select(*kept)
    return by_option.unionByName(by_bound.select(*kept)).unionByName(of_type)


def notifications(envelopes: DataFrame, rules: DataFrame) -> DataFrame:
    """One row (``to``, ``subject``, ``body``) per event and matching rule of the table."""
    found = candidates(envelopes, rules).join(rules.drop("event_types"), "rule_id")
    found = found.where(F.forall("tests", lambda t: _holds(t, F.col("values"))))

    def part(test: Column) -> Column:
        shown = F.get(F.filter("values", lambda v: v["key"] == test["key"]), F.lit(0))["shown"]
        return F.concat(test["key"], F.lit("="), shown, F.lit(" (threshold="), test["shown"], F.lit(")"))

    detail = F.array_join(F.array_compact(F.transform("tests", part)), ", ")
    shown = F.when(detail == "", "no matching thresholds").otherwise(detail)
    # The wording of a subject line.
    subject = F.concat(F.lit("Alert: "), "event_type", F.lit(" ["), shown, F.lit("]"))
    body = F.to_json(F.struct(*ENVELOPE, "data"))
    return found.select(F.col("email").alias("to"), subject.alias("subject"), body.alias("body"))


def _parted(rules: DataFrame) -> DataFrame:
    """The rules with their first test of either kind, and whether there is no other."""
    options = F.filter("tests", lambda t: t["bound"].isNull())
    bounds = F.filter("tests", lambda t: t["bound"].isNotNull())
    whole = F.forall("tests", lambda t: t["key"].isNotNull())
    return rules.withColumns(
        {
            "simple": F.coalesce((F.size(options) < 2) & (F.size(bounds) < 2) & whole, F.lit(False)),
            "option": F.get(options, F.lit(0)),
            "least": F.get(bounds, F.lit(0)),
        }
    )


def _name(key: Column | str | None) -> Column:
    """A key as a join key; no key is one of its own."""
    return F.coalesce(F.concat(F.lit("k"), F.lit(key)), F.lit(""))


def _entries(parted: DataFrame) -> DataFrame:
    """A row per event type and option of each rule, by group and bound; no bound is passed by all."""
    option, least = F.col("option"), F.col("least")
    tokens = F.when(option.isNull(), F.array(F.lit(""))).otherwise(_tokens(option))
    # As in ``notifications``, a row finds all rows of its rule_id.
    copies = F.count("*").over(Window.partitionBy("rule_id"))
    rows = parted.where("simple and rule_id is not null").withColumn("copies", copies)
    typed = rows.withColumn("event_type", F.explode(F.array_distinct("event_types")))
    return typed.select(
        "email",
        "copies",
        "event_type",
        _name(option["key"]).alias("option_key"),
        _name(least["key"]).alias("bound_key"),
        F.explode(tokens).alias("token"),
        (F.coalesce(least["bound"], F.lit(float("-inf"))) + 0.0).alias("bound"),
    )


def _simple_tallies(envelopes: DataFrame, parted: DataFrame, kinds: list[tuple[str | None, str | None]]) -> DataFrame:
    data = reader(envelopes)
    seen = [
        F.struct(
            _name(option).alias("option_key"),
            _name(bound).alias("bound_key"),
            (F.lit("") if option is None else _token(*data.option(option))).alias("token"),
            (F.lit(0.0) if bound is None else data.number(bound)).alias("value"),
        )
        for option, bound in kinds
    ]
    body = F.to_json(F.struct(*ENVELOPE, "data")).alias("body")
    events = envelopes.select("event_type", body, F.inline(F.array(*seen))).where("value is not null")
    entries = _entries(parted)
    bounds = F.sort_array(F.collect_list(F.struct("bound"))).alias("bounds")
    ladders = entries.select(*GROUP, "bound").distinct().groupBy(*GROUP).agg(bounds)
    free = F.col("token") == ""
    part = F.when(free, F.pmod(F.hash("body"), F.lit(PARTS))).otherwise(0)
    parts = F.when(free, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    met = _with_steps(ladders).withColumn("part", F.explode(parts))
    placed = once(events.withColumn("part", part).join(met, [*GROUP, "part"]), place=_passed(F.col("value")))
    # The place first: rows are sorted for a least text, and the others are mostly equal.
    folded = placed.groupBy("place", *GROUP).agg(F.count("*").alias("letters"), F.min("body").alias("first_body"))
    # An event that passes ``place`` bounds passes the first ``place`` of them.
    rungs = ladders.select(*GROUP, F.posexplode("bounds").alias("before", "rung"))
    rungs = rungs.select(*GROUP, (F.col("before") + 1).alias("place"), "rung.bound")
    above = Window.partitionBy(*GROUP).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    reached = rungs.join(folded, [*GROUP, "place"], "left").select(
        *GROUP,
        "bound",
        F.sum("letters").over(above).alias("letters"),
        F.min("first_body").over(above).alias("first_body"),
    )
    found = entries.join(reached.where("letters > 0"), [*GROUP, "bound"])
    return found.select(F.col("email").alias("to"), (F.col("letters") * F.col("copies")).alias("letters"), "first_body")


def tallies(envelopes: DataFrame, rules: DataFrame) -> DataFrame:
    """``letters`` and ``first_body``, the least in order of text, of each recipient (``to``) of a letter.

    The same as counting ``notifications``. Rows that share a ``rule_id`` are copies of one rule.
    """
    parted = _parted(rules)
    kinds = parted.select("simple", F.col("option.key").alias("option"), F.col("least.key").alias("bound"))
    kinds = kinds.distinct().collect()
    simple = [(k["option"], k["bound"]) for k in kinds if k["simple"]]
    found = _simple_tallies(envelopes, parted, simple) if simple else None
    if not simple or len(simple) < len(kinds):
        letters = notifications(envelopes, parted.where("not simple").select(*rules.columns))
        rest = letters.select("to", F.lit(1).cast("long").alias("letters"), F.col("body").alias("first_body"))
        found = found.unionByName(rest) if found else rest
    return found.groupBy("to").agg(F.sum("letters").alias("letters"), F.min("first_body").alias("first_body"))
