"""Refusals, the two tiers of scores, and where each pair goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.functions import normalize as N
from kinfold.functions.similarity import jaro_winkler_column, token_set_column
from kinfold.schema import REASONS

#: What each part weighs, and what different phones cost.
WEIGHTS = {"name": 0.45, "company": 0.30, "domain": 0.15, "phone": 0.10}
PHONE_PENALTY = 0.10
#: Shares of surname and given name, a missing surname, and the floors of a shared line.
SURNAME_SHARE, GIVEN_SHARE, NO_SURNAME = 0.6, 0.4, 0.5
SURNAME_FLOOR, GIVEN_FLOOR = 0.92, 0.85
#: The ladder of given names.
SAME_INITIAL, INITIAL_FITS, SAME_FORMAL, DIFFERENT_FORMAL = 0.6, 0.85, 0.95, 0.4

#: What of a record is compared or shown, and what is worked out once for all its pairs.
_PARTS = ("name", "email", "phone", "company", "domain")


def _false_if_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _reason(rule: str, verdict: str | Column, detail: Column, weight: Column | None = None) -> Column:
    verdict = F.lit(verdict) if isinstance(verdict, str) else verdict
    weight = F.lit(None).cast("double") if weight is None else weight
    return F.struct(F.lit(rule).alias("rule"), verdict.alias("verdict"), detail.alias("detail"), weight.alias("weight"))


def _shown(value: Column) -> Column:
    return F.format_string("%.2f", value)


def sides(records: DataFrame) -> DataFrame:
    """``records`` with only what pairs are compared by, worked out as far as one side alone allows."""
    bare = F.regexp_replace(F.coalesce("name.first", F.lit("")), r"[.\s]+$", "")
    return records.select(
        "id",
        F.struct("name.first", "name.last", "name.suffix", "name.groups", "name.known", bare.alias("bare"), N.is_initial(bare).alias("short")).alias("name"),
        F.struct("email.canonical", "email.kind", "email.domain", (N.identifies_person(F.col("email.kind")) & F.col("email.canonical").isNotNull()).alias("person")).alias("email"),
        F.struct("phone.e164", "phone.extension", "phone.valid", N.last_seven(F.col("phone.e164")).alias("seven")).alias("phone"),
        F.struct("company.key").alias("company"),
        F.struct("domain.value").alias("domain"),
    )


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b) with both ``sides`` as structs ``x`` and ``y``; pairs with an unknown id go."""
    part = F.struct("id", *_PARTS)
    x, y = records.select(F.col("id").alias("a"), part.alias("x")), records.select(F.col("id").alias("b"), part.alias("y"))
    return pairs.join(x, "a").join(y, "b")


def oriented(constraints: DataFrame, kind: str) -> DataFrame:
    """Distinct (a, b) of the decisions of one kind, the smaller id first."""
    return constraints.filter(F.col("kind") == kind).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: The rules that refuse a pair.
TWO_EMPLOYERS, GENERATIONS, HUMAN = "corporate mailboxes at two employers", "generations differ", "human"


def refusing_rule() -> Column:
    """The first rule that refuses a pair; null if none does."""
    x, y = F.col("x"), F.col("y")
    corporate = (x["email"]["kind"] == "personal") & (y["email"]["kind"] == "personal")
    apart = corporate & (x["email"]["canonical"] != y["email"]["canonical"]) & (x["email"]["domain"] != y["email"]["domain"])
    generations = x["name"]["suffix"] != y["name"]["suffix"]
    return F.when(_false_if_null(apart), F.lit(TWO_EMPLOYERS)).when(_false_if_null(generations), F.lit(GENERATIONS))


def _refusal(rule: Column) -> Column:
    """``rule`` as a reason."""
    x, y = F.col("x"), F.col("y")
    both = F.concat_ws(" and ", x["email"]["canonical"], y["email"]["canonical"])
    return (
        F.when(rule == TWO_EMPLOYERS, _reason(TWO_EMPLOYERS, "refuse", F.concat(both, F.lit(": a new job and a namesake look alike here"))))
        .when(rule == GENERATIONS, _reason(GENERATIONS, "refuse", F.concat(F.upper(x["name"]["suffix"]), F.lit(" and "), F.upper(y["name"]["suffix"]), F.lit(": parent and child share all else"))))
        .when(rule == HUMAN, _reason("marked as different by a reviewer", "refuse", F.lit("a decision that no score overrules")))
    )


def given_ladder(x: Column, y: Column) -> Column:
    """How compatible two given names are, as far as no string similarity is needed; else null."""
    a, b = x["bare"], y["bare"]
    fits = F.substring(a, 1, 1) == F.substring(b, 1, 1)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(x["short"] & y["short"], F.when(fits, F.lit(SAME_INITIAL)).otherwise(F.lit(0.0)))
        .when(x["short"] | y["short"], F.when(fits, F.lit(INITIAL_FITS)).otherwise(F.lit(0.0)))
        .when(a == b, F.lit(1.0))
        .when(F.arrays_overlap(x["groups"], y["groups"]), F.lit(SAME_FORMAL))
        .when(x["known"] & y["known"], F.lit(DIFFERENT_FORMAL))
    )


def same_employer() -> Column:
    x, y = F.col("x"), F.col("y")
    return _false_if_null(x["company"]["key"] == y["company"]["key"]) | _false_if_null(x["domain"]["value"] == y["domain"]["value"])


def same_mailbox() -> Column:
    x, y = F.col("x.email"), F.col("y.email")
    return x["person"] & y["person"] & _false_if_null(x["canonical"] == y["canonical"])


def same_line() -> Column:
    """One valid number and no two extensions; names and employer are checked apart."""
    x, y = F.col("x.phone"), F.col("y.phone")
    return x["valid"] & y["valid"] & _false_if_null(x["e164"] == y["e164"]) & ~_false_if_null(x["extension"] != y["extension"])


def _name_reasons() -> list[Column]:
    x, y = F.col("x.name"), F.col("y.name")
    there = x["last"].isNotNull() & y["last"].isNotNull()
    surname = F.when(there, F.concat_ws(" ", x["last"], F.lit("and"), y["last"], _shown(F.col("surname")))).otherwise(F.lit("missing on one side"))
    given = F.concat_ws(" ", F.coalesce(x["first"], F.lit("none")), F.lit("and"), F.coalesce(y["first"], F.lit("none")), _shown(F.col("given")))
    return [
        _reason("surname", F.when(there & (F.col("surname") >= 0.9), F.lit("match")).otherwise(F.lit("mismatch")), surname),
        _reason("given name", F.when(F.col("given") >= 0.85, F.lit("match")).otherwise(F.lit("mismatch")), given),
    ]


def compared(pairs: DataFrame, config: Config) -> DataFrame:
    """``pairs`` with records, and their ``kind`` and ``score`` with all that these rest on.

    Pairs with ``refused`` or one mailbox need no comparison, given names that the ladder
    settles none, and company names one only past the name gate; what needs none goes to
    Python as null. Terms are added in a fixed order, so equal inputs give equal bits.
    """
    x, y = F.col("x"), F.col("y")
    found = pairs.withColumn("by_mailbox", same_mailbox()).withColumn("open", F.col("refused").isNull() & ~F.col("by_mailbox"))
    ladder = given_ladder(x["name"], y["name"])
    lasts, firsts = ([F.when(F.col("open") & by, r["name"][f]) for r in (x, y)] for f, by in (("last", F.lit(True)), ("first", F.col("ladder").isNull())))
    found = found.withColumn("ladder", ladder).withColumns({"_surname": jaro_winkler_column(*lasts), "_given": jaro_winkler_column(*firsts)})
    found = found.withColumns({"surname": F.coalesce("_surname", F.lit(NO_SURNAME)), "given": F.coalesce("ladder", "_given")}).drop("_surname", "_given", "ladder")
    found = found.withColumn("name_score", F.lit(SURNAME_SHARE) * F.col("surname") + F.lit(GIVEN_SHARE) * F.col("given"))
    by_line = same_line() & (F.col("surname") >= SURNAME_FLOOR) & (F.col("given") >= GIVEN_FLOOR) & same_employer()
    found = found.withColumns({"by_line": by_line, "passed": F.col("name_score") >= config.name_gate})
    keys = [F.when(F.col("open") & F.col("passed") & ~F.col("by_line"), r["company"]["key"]) for r in (x, y)]
    found = found.withColumn("company_score", token_set_column(*keys))

    same_seven, two_phones = _phones()
    total = F.lit(WEIGHTS["name"]) * F.col("name_score") + F.coalesce(F.lit(WEIGHTS["company"]) * F.col("company_score"), F.lit(0.0))
    total = total + F.when(same_domain(), F.lit(WEIGHTS["domain"])).otherwise(F.lit(0.0))
    total = F.when(same_seven, total + F.lit(WEIGHTS["phone"])).when(two_phones, total - F.lit(PHONE_PENALTY)).otherwise(total)
    sure = F.col("by_mailbox") | F.col("by_line")
    score = F.when(F.col("refused").isNotNull(), F.lit(0.0)).when(sure, F.lit(1.0)).when(~F.col("passed"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    kind = F.when(F.col("refused").isNotNull(), F.lit("refused")).when(sure, F.lit("authoritative")).otherwise(F.lit("probable"))
    return found.withColumns({"kind": kind, "score": score})


def same_domain() -> Column:
    return _false_if_null(F.col("x.domain.value") == F.col("y.domain.value"))


def _phones() -> tuple[Column, Column]:
    """Whether the last seven digits agree, and whether two valid phones differ in them."""
    x, y = F.col("x.phone"), F.col("y.phone")
    same_seven = _false_if_null(x["seven"] == y["seven"])
    return same_seven, ~same_seven & x["valid"] & y["valid"]


def reasons(config: Config) -> Column:
    """Why a pair of ``compared`` has its kind and score."""
    x, y = F.col("x"), F.col("y")
    names = _name_reasons()
    by_mailbox = F.array(_reason("one personal mailbox", "match", x["email"]["canonical"]))
    line = F.array(
        _reason("one phone line", "match", F.concat_ws(" x", x["phone"]["e164"], x["phone"]["extension"])), *names,
        _reason("one employer", "match", F.coalesce(x["company"]["key"], x["domain"]["value"], F.lit(""))),
    )
    gate = F.concat(_shown(F.col("name_score")), F.lit(f" is below the floor of {config.name_gate:.2f}; nothing else can carry the pair"))
    phones = F.concat_ws(" and ", x["phone"]["e164"], y["phone"]["e164"])
    same_seven, two_phones = _phones()
    name_part, company_part = F.lit(WEIGHTS["name"]) * F.col("name_score"), F.lit(WEIGHTS["company"]) * F.col("company_score")
    probable = F.array_compact(
        F.array(
            *names,
            _reason("name", "match", F.concat(F.lit("both halves together "), _shown(F.col("name_score"))), name_part),
            F.when(company_part.isNotNull(), _reason("company", F.when(F.col("company_score") >= 0.8, F.lit("match")).otherwise(F.lit("mismatch")), F.concat_ws(" ", x["company"]["key"], F.lit("and"), y["company"]["key"], _shown(F.col("company_score"))), company_part)),
            F.when(same_domain(), _reason("domain", "match", x["domain"]["value"], F.lit(WEIGHTS["domain"]))),
            F.when(same_seven, _reason("phone", "match", F.concat(F.lit("last seven digits "), x["phone"]["seven"]), F.lit(WEIGHTS["phone"]))).when(two_phones, _reason("phone", "mismatch", F.concat(phones, F.lit(": weak, as a person can have two")), F.lit(-PHONE_PENALTY))),
        )
    )
    said = F.when(F.col("by_mailbox"), by_mailbox.cast(REASONS)).when(F.col("by_line"), line.cast(REASONS))
    said = said.when(~F.col("passed"), F.array(*names, _reason("name gate", "mismatch", gate)).cast(REASONS)).otherwise(probable.cast(REASONS))
    return F.when(F.col("refused").isNotNull(), F.array(_refusal(F.col("refused"))).cast(REASONS)).otherwise(said)


#: What a pair of ``routed`` is kept with: enough to explain it without comparing again.
PROOF = ("refused", "by_mailbox", "by_line", "passed", "surname", "given", "name_score", "company_score")


def routed(pairs: DataFrame, records: DataFrame, constraints: DataFrame, config: Config) -> DataFrame:
    """(a, b, kind, score, route, proposed, ...) of ``pairs`` and of linked pairs that blocking missed; ``records`` are ``sides``.

    ``route`` is refused, accepted, review or below. A decision that two rows differ comes
    before all; a rule's refusal comes before a decision to link, but only for pairs that
    blocking proposed, as others are never put to the rules.
    """
    apart = oriented(constraints, "must-not-link").withColumn("apart", F.lit(True))
    linked = oriented(constraints, "link").withColumn("linked", F.lit(True))
    marked = pairs.join(apart, ["a", "b"], "left").join(linked, ["a", "b"], "left").withColumn("proposed", F.lit(True))
    missed = linked.join(pairs, ["a", "b"], "left_anti").select("a", "b", F.lit(None).cast("boolean").alias("apart"), "linked", F.lit(False).alias("proposed"))
    full = with_records(marked.unionByName(missed), records)
    refusal = F.when(F.col("proposed"), F.when(F.coalesce("apart", F.lit(False)), F.lit(HUMAN)).otherwise(refusing_rule()))
    edges = compared(full.withColumn("refused", refusal), config)
    by_hand = F.coalesce(F.col("linked"), F.lit(False))
    accepted = (F.col("kind") == "authoritative") | by_hand
    refused = F.col("refused").isNotNull()
    route = F.when(refused, F.lit("refused")).when(accepted, F.lit("accepted")).when(F.col("score") >= config.review_threshold, F.lit("review")).otherwise(F.lit("below"))
    kind = F.when(~refused & accepted, F.lit("authoritative")).otherwise(F.col("kind"))
    return edges.select("a", "b", kind.alias("kind"), "score", route.alias("route"), "proposed", *PROOF)


def explained(edges: DataFrame, records: DataFrame, config: Config) -> DataFrame:
    """``edges`` of ``routed`` with ``reasons``."""
    why = reasons(config)
    missed = _reason("linked by a reviewer", "match", F.lit("blocking never brought the two together"))
    why = F.when(F.col("proposed"), why).otherwise(F.concat(why, F.array(missed).cast(REASONS)))
    return with_records(edges, records).withColumn("reasons", why).drop("x", "y")
