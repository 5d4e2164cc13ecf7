"""Hash chains: a ledger of transactions in blocks, and one chain of events per order.

Blocks are JSON with sorted keys under SHA-256. A chain is an array of block structs in one
row, built by unrolled expressions, so orders are independent of each other and no Python
runs. Hashed texts hold strings and integers only: scores are given as text with a fixed
number of decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json, canonical_timestamp, is_canonical_timestamp, is_printable, is_sha256_hex, json_string, printable_json_string, risk_level

SCHEMA_VERSION = "1.1"
EVENTS = ("ORDER_GENESIS", "ORDER_CREATED", "SHIPMENT_RECORDED", "DELIVERY_STATUS_RECORDED", "AI_RISK_ASSESSED")
POLICY_PREFIX = "AUTHORIZED_VALIDATOR_"
LEVELS = ("LOW", "MEDIUM", "HIGH")
CHECKS = tuple(f"c{i}" for i in range(1, 9))
#: Checks and validators of each band, and of the fixed policies.
BANDS = {"LOW": (4, 1), "MEDIUM": (6, 1), "HIGH": (8, 3)}
POLICIES = {"B0": (4, 1), "B1": (8, 3)}
PROVENANCE = ("model_configuration_provenance", "hybrid_k13_provenance", "generation_stage_provenance")
SCENARIOS = tuple(f"PA-{i:02d}" for i in range(1, 10))

REFERENCE = "struct<order_id:string,risk_score:string,risk_level:string,provenance:string,record_digest:string>"
BLOCK = (
    f"struct<order_id:string,block_index:int,event_type:string,event_timestamp:string,payload_digest:string,"
    f"ai_risk_reference:{REFERENCE},validation_policy:string,previous_hash:string,block_hash:string>"
)


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def record_digest(order_id: Column, score: Column, level: Column, provenance: Column) -> Column:
    """The digest of a risk record: of its six fields."""
    return sha(
        canonical_json(
            order_id=json_string(order_id), risk_score=score, risk_level=json_string(level), **{p: json_string(provenance) for p in PROVENANCE}
        )
    )


def reference(order_id: Column, score: Column, provenance: str = "synthetic") -> Column:
    """A risk reference of a score given as text; its digest binds all fields."""
    level, p = risk_level(score.cast("double")), F.lit(provenance)
    return F.struct(
        order_id.alias("order_id"), score.alias("risk_score"), level.alias("risk_level"), p.alias("provenance"), record_digest(order_id, score, level, p).alias("record_digest")
    ).cast(REFERENCE)


def _reference_json(r: Column, string=json_string) -> Column:
    text = canonical_json(
        order_id=string(r.order_id), risk_score=r.risk_score, risk_level=string(r.risk_level), record_digest=string(r.record_digest),
        **{p: string(r.provenance) for p in PROVENANCE},
    )
    return F.when(r.isNull(), F.lit("null")).otherwise(text)


def preimage(b: Column) -> Column:
    """The canonical JSON of a block without its own hash. All its texts are looked at together:
    only a block that holds other than printable ASCII has its characters escaped."""

    def text(string) -> Column:
        return canonical_json(
            ai_risk_reference=_reference_json(b.ai_risk_reference, string), block_index=b.block_index, event_timestamp=string(b.event_timestamp),
            event_type=string(b.event_type), order_id=string(b.order_id), payload_digest=string(b.payload_digest), payload_ref=F.lit("null"),
            previous_hash=string(b.previous_hash), schema_version=string(F.lit(SCHEMA_VERSION)), validation_policy=string(b.validation_policy),
        )

    r = b.ai_risk_reference
    every = F.concat_ws(
        "", b.event_timestamp, b.event_type, b.order_id, b.payload_digest, b.previous_hash, b.validation_policy, r.order_id, r.risk_level, r.record_digest, r.provenance
    )
    return F.when(is_printable(every), text(printable_json_string)).otherwise(text(json_string))


def block_hash(b: Column) -> Column:
    return sha(preimage(b))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sign(b: Column, **changes: Column) -> Column:
    """The block with changed fields and its hash computed anew."""
    for name, value in changes.items():
        b = b.withField(name, value)
    return let(b, lambda x: x.withField("block_hash", block_hash(x)))


def new_block(order_id: Column, index: Column | int, event: Column | str, at: Column, payload: Column, previous: Column, ref: Column | None = None, level: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    b = F.struct(
        order_id.alias("order_id"), lit(index).cast("int").alias("block_index"), lit(event).alias("event_type"), at.alias("event_timestamp"), payload.alias("payload_digest"),
        (F.lit(None) if ref is None else ref).cast(REFERENCE).alias("ai_risk_reference"),
        F.concat(F.lit(POLICY_PREFIX), F.lit("MEDIUM") if level is None else level).alias("validation_policy"),
        previous.cast("string").alias("previous_hash"), F.lit("").alias("block_hash"),
    ).cast(BLOCK)
    return sign(b)


# order lines to events


def line_digest(columns: dict[str, Column]) -> Column:
    """The digest of a line: JSON of its fields, numbers as decimal text."""
    return sha(canonical_json(**columns))


def _ids(rows: DataFrame):
    """How to write the ids of ``rows`` as JSON strings: integers need no look at their characters."""
    kinds = dict(rows.dtypes)
    return printable_json_string if all(kinds[c] in ("int", "bigint") for c in ("order_id", "item_id") if c in kinds) else json_string


def digest_of_line(string=json_string) -> Column:
    """The digest of an order line by its columns; ``string`` writes its ids."""
    return line_digest(
        {
            "order_id": string(F.col("order_id").cast("string")), "transaction_id": string(F.col("item_id").cast("string")),
            "quantity": F.col("quantity").cast("long"), "total_cents": F.round(F.col("total") * 100).cast("long"), "status": json_string(F.col("order_status")),
        }
    )


def line_digests(lines: DataFrame) -> DataFrame:
    """(order_id, item_id, digest, n_rows, n_variants): copies of a line collapse; variants are a conflict."""
    rows = lines.select("order_id", "item_id", digest_of_line(_ids(lines)).alias("d"))
    per = rows.groupBy("order_id", "item_id", "d").agg(F.count("*").alias("n"))
    return per.groupBy("order_id", "item_id").agg(F.min("d").alias("digest"), F.sum("n").alias("n_rows"), F.count("*").alias("n_variants"))


def order_digests(lines: DataFrame) -> DataFrame:
    """(order_id, digest, n_lines, n_conflicts): the lines of an order in numeric order of their ids."""
    per = line_digests(lines)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "digest"))), lambda x: printable_json_string(x.digest)), ",")
    return per.groupBy("order_id").agg(
        sha(F.concat(F.lit("["), listed, F.lit("]"))).alias("digest"), F.count("*").alias("n_lines"), F.count_if(F.col("n_variants") > 1).alias("n_conflicts")
    )


def order_consistency(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(order_id, consistent): every order-level field has one value in all lines; blank against present is a difference."""
    aggs = [F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("∅"))).alias(f"__{f}") for f in fields]
    test = F.lit(True)
    for f in fields:
        test &= F.col(f"__{f}") == 1
    return lines.groupBy("order_id").agg(*aggs).select("order_id", test.alias("consistent"))


def build_chains(orders: DataFrame) -> DataFrame:
    """(order_id, chain) from rows (order_id, created, shipped, delivered, lines_digest, delivery_status, risk_score).

    Times are canonical text, risk_score is text or null. Four events, and the risk
    assessment as the fifth where there is a score.
    """
    string = _ids(orders.select("order_id"))
    rows = orders.withColumn("__o", F.col("order_id").cast("string"))
    o, created, r = F.col("__o"), F.col("created"), F.col("__r")
    rows = rows.withColumn("__r", F.when(F.col("risk_score").isNotNull(), reference(o, F.coalesce("risk_score", F.lit("0.0")))))
    rows = rows.withColumn("__rj", _reference_json(r, string))
    plain = printable_json_string  # canonical times, digests and levels
    payloads = [
        sha(canonical_json(order_id=string(o), order_creation_canonical=plain(created))), F.col("lines_digest"),
        sha(canonical_json(order_id=string(o), shipped=plain(F.col("shipped")))), sha(canonical_json(order_id=string(o), delivery_status=json_string(F.col("delivery_status")))),
        sha(F.col("__rj")),
    ]
    times = [created, created, F.col("shipped"), F.col("delivered"), F.col("delivered")]
    blocks = []
    # each hash is a column of its own: the next block and the array read it, nothing is computed twice
    for i, (event, at, payload) in enumerate(zip(EVENTS, times, payloads, strict=True)):
        previous = F.col(f"__h{i - 1}") if i else F.lit(None).cast("string")
        ref, policy = (r, F.concat(F.lit(POLICY_PREFIX), r.risk_level)) if i == 4 else (F.lit(None), F.lit(POLICY_PREFIX + "MEDIUM"))
        rows = rows.withColumn(f"__p{i}", payload)
        text = canonical_json(
            ai_risk_reference=F.col("__rj") if i == 4 else F.lit("null"), block_index=F.lit(i), event_timestamp=plain(at), event_type=plain(F.lit(event)), order_id=string(o),
            payload_digest=plain(F.col(f"__p{i}")), payload_ref=F.lit("null"), previous_hash=plain(previous), schema_version=plain(F.lit(SCHEMA_VERSION)), validation_policy=plain(policy),
        )
        rows = rows.withColumn(f"__h{i}", sha(text))
        blocks.append(
            F.struct(
                o.alias("order_id"), F.lit(i).alias("block_index"), F.lit(event).alias("event_type"), at.alias("event_timestamp"), F.col(f"__p{i}").alias("payload_digest"),
                ref.cast(REFERENCE).alias("ai_risk_reference"), policy.alias("validation_policy"), previous.alias("previous_hash"), F.col(f"__h{i}").alias("block_hash"),
            ).cast(BLOCK)
        )
    return rows.select(o.alias("order_id"), F.when(r.isNull(), F.array(*blocks[:4])).otherwise(F.array(*blocks)).alias("chain"))


def extend_chains(chains: DataFrame, scores: DataFrame) -> DataFrame:
    """Chains of four events with the risk assessment appended, from (order_id, risk_score).

    A chain that has no score, or that already ends in an assessment, stays as it is.
    """
    s = scores.select(F.col("order_id").cast("string").alias("__id"), F.col("risk_score").alias("__score"))
    rows = chains.join(s, F.col("order_id") == F.col("__id"), "left").withColumn("__last", F.element_at("chain", -1))
    o = F.col("order_id")
    rows = rows.withColumn("__r", F.when(F.col("__score").isNotNull(), reference(o, F.coalesce("__score", F.lit("0.0")))))
    block = new_block(
        o, 4, EVENTS[4], F.col("__last.event_timestamp"), payload_of_reference(F.col("__r")), F.col("__last.block_hash"), F.col("__r"), F.col("__r.risk_level")
    )
    open_ = F.col("__r").isNotNull() & (F.col("__last.block_index") == 3)
    return rows.withColumn("chain", F.when(open_, F.concat("chain", F.array(block))).otherwise(F.col("chain"))).select(chains.columns)


def payload_of_reference(r: Column) -> Column:
    return sha(_reference_json(r))


def order_events(lines: DataFrame, scores: bool = True) -> DataFrame:
    """The input of :func:`build_chains` from order lines: one row an order, in one pass.

    The score is the share of late lines in hundredths, as text. Copies of a line collapse in
    the digest, as in :func:`order_digests`, and count in the score.
    """
    keys = ["order_id", "item_id", "d"]
    folds = {"o": F.min, "s": F.min, "t": F.max, "delivery_status": F.min, "late": F.sum, "n": F.sum}
    rows = lines.select(
        "order_id", "item_id", digest_of_line(_ids(lines)).alias("d"), F.col("order_ts").alias("o"), F.col("ship_ts").alias("s"), F.col("ship_ts").alias("t"), "delivery_status",
        F.col("late").cast("long").alias("late"), F.lit(1).cast("long").alias("n"),
    )
    for by in (keys, keys[:2]):
        digest = [F.min("d").alias("d")] if by != keys else []
        rows = rows.groupBy(*by).agg(*digest, *[f(c).alias(c) for c, f in folds.items()])
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "d"))), lambda x: printable_json_string(x.d)), ",")
    per = rows.groupBy("order_id").agg(sha(F.concat(F.lit("["), listed, F.lit("]"))).alias("lines_digest"), *[f(c).alias(c) for c, f in folds.items()])
    hundredths = F.floor(100 * F.col("late") / F.col("n")).cast("long")
    score = F.when(hundredths == 100, F.lit("1.00")).otherwise(F.concat(F.lit("0."), F.lpad(hundredths.cast("string"), 2, "0")))
    start = F.col("o")
    return per.select(
        "order_id", canonical_timestamp(start).alias("created"), canonical_timestamp(F.greatest(start, F.col("s"))).alias("shipped"),
        canonical_timestamp(F.greatest(start, F.col("t"))).alias("delivered"), "lines_digest", "delivery_status",
        (score if scores else F.lit(None).cast("string")).alias("risk_score"),
    )


# checks


def checks(ctx: Column, block: Column, order_id: Column, hashes: Column, risk_digest: Column) -> dict[str, Column]:
    """c1 to c8 of the last block of a chain. c3 and c4 look at the place before the block's
    index, c8 at the whole chain. ``hashes`` are those of the chain's blocks, ``risk_digest``
    that of the block's reference, as they come out now."""
    before = F.try_element_at(ctx, block.block_index)  # counted from 1
    r = block.ai_risk_reference
    risk = block.event_type == EVENTS[4]
    shape = (
        block.order_id.rlike("^(0|[1-9][0-9]*)$") & (block.block_index >= 0) & block.event_type.isin(*EVENTS) & is_canonical_timestamp(block.event_timestamp)
        & is_sha256_hex(block.payload_digest) & block.validation_policy.isin(*[POLICY_PREFIX + x for x in LEVELS]) & is_sha256_hex(block.block_hash)
        & F.when(block.block_index == 0, block.previous_hash.isNull()).otherwise(is_sha256_hex(block.previous_hash))
    )
    score = r.risk_score.try_cast("double")
    bound = (
        r.isNotNull() & (risk_digest == r.record_digest) & score.between(0.0, 1.0)
        & r.risk_level.isin(*LEVELS) & (r.order_id == order_id) & (F.length(r.provenance) > 0)
    )
    places = F.transform(
        ctx,
        lambda b, i: (b.block_index == i)
        & (F.element_at(hashes, i + 1) == b.block_hash)
        & F.when(i == 0, F.lit(True)).otherwise(b.previous_hash.eqNullSafe(F.try_element_at(ctx, F.greatest(i, F.lit(1))).block_hash)),
    )
    whole = F.forall(places, lambda ok: F.coalesce(ok, F.lit(False)))
    first = block.block_index == 0
    found = {
        "c1": shape,
        "c2": F.element_at(hashes, -1) == block.block_hash,
        "c3": F.when(first, block.previous_hash.isNull()).otherwise(block.previous_hash == before.block_hash),
        "c4": first | (before.event_timestamp <= block.event_timestamp),
        "c5": (block.order_id == order_id) & (block.order_id == F.element_at(ctx, 1).order_id),
        "c6": ~risk | r.isNotNull(),
        "c7": ~risk | bound,
        "c8": (block.block_index == F.size(ctx) - 1) & whole,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def adaptive_level(block: Column, order_id: Column, risk_digest: Column | None = None) -> Column:
    """The declared band of a well-formed, digest-bound reference; anything else is MEDIUM."""
    r = block.ai_risk_reference
    now = record_digest(r.order_id, r.risk_score, r.risk_level, r.provenance) if risk_digest is None else risk_digest
    ok = (now == r.record_digest) & (r.order_id == order_id) & r.risk_level.isin(*LEVELS)
    return F.when(F.coalesce(r.isNotNull() & ok, F.lit(False)), r.risk_level).otherwise("MEDIUM")


def with_checks(chains: DataFrame, order_id: str = "expected_id") -> DataFrame:
    """Add the head block's checks c1 to c8 and its adaptive level. ``order_id`` names the expected id's column."""
    rows = chains.withColumn("__head", F.element_at("chain", -1)).withColumn("__hashes", F.transform("chain", block_hash))
    head, r = F.col("__head"), F.col("__head.ai_risk_reference")
    rows = rows.withColumn("__risk", record_digest(r.order_id, r.risk_score, r.risk_level, r.provenance))
    found = checks(F.col("chain"), head, F.col(order_id), F.col("__hashes"), F.col("__risk"))
    return rows.withColumns({**found, "level": adaptive_level(head, F.col(order_id), F.col("__risk"))}).drop("__head", "__hashes", "__risk")


def verdicts(checked: DataFrame) -> DataFrame:
    """Add accepted_B0, accepted_B1 and accepted_P. Validators are alike, so a quorum agrees with one of them."""
    upto = lambda n: F.expr(" AND ".join(CHECKS[:n]))
    adaptive = F.when(F.col("level") == "LOW", upto(4)).when(F.col("level") == "HIGH", upto(8)).otherwise(upto(6))
    return checked.withColumns({"accepted_B0": upto(4), "accepted_B1": upto(8), "accepted_P": adaptive})


def verdict_lists(checked: DataFrame) -> DataFrame:
    """Add applied, passed and failed: the names of the checks that the level's band holds, in order."""
    n = F.when(F.col("level") == "LOW", BANDS["LOW"][0]).when(F.col("level") == "HIGH", BANDS["HIGH"][0]).otherwise(BANDS["MEDIUM"][0])
    every = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in CHECKS])
    held = F.slice(every, F.lit(1), n)
    names = lambda xs: F.transform(xs, lambda x: x["name"])
    return checked.withColumns({"applied": names(held), "passed": names(F.filter(held, lambda x: x.ok)), "failed": names(F.filter(held, lambda x: ~x.ok))})


def quorum(votes: Column) -> Column:
    """Whether all validators agree and accept: any disagreement, a missing vote or no validator rejects."""
    return (F.size(votes) > 0) & F.forall(votes, lambda v: F.coalesce(v, F.lit(False)))


def operation_counts(levels: DataFrame, level: str = "level") -> DataFrame:
    """(policy, orders, checks, validators, runs): fixed policies and the adaptive one, over rows with a level."""
    n = levels.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"))
    rows = []
    for name, (c, v) in POLICIES.items():
        rows.append(F.struct(F.lit(name).alias("policy"), F.lit(c).alias("checks"), F.lit(v).alias("validators")))
    band = lambda i: F.when(F.col("level") == "LOW", BANDS["LOW"][i]).when(F.col("level") == "HIGH", BANDS["HIGH"][i]).otherwise(BANDS["MEDIUM"][i])
    rows.append(F.struct(F.lit("P").alias("policy"), band(0).alias("checks"), band(1).alias("validators")))
    return n.select("n", F.inline(F.array(*rows))).groupBy("policy").agg(
        F.sum("n").alias("orders"), F.sum(F.col("n") * F.col("checks")).alias("checks"), F.sum(F.col("n") * F.col("validators")).alias("validators"),
        F.sum(F.col("n") * F.col("checks") * F.col("validators")).alias("runs"),
    )


# tampering


def _other(order_id: Column) -> Column:
    return (order_id.cast("long") + 1).cast("string")


def _marked(word: str, order_id: Column) -> Column:
    return sha(canonical_json(**{word: json_string(order_id)}))


def _edited(c: Column, o: Column, scenario: str) -> Column:
    """The chain after a scenario; o is the true id."""
    at = lambda i: F.element_at(c, i)
    n = F.size(c)
    if scenario == "PA-01":
        new = F.concat(F.slice(c, F.lit(1), n - 1), F.array(sign(at(-1), payload_digest=_marked("tampered", o))))
    elif scenario == "PA-02":
        new = F.concat(F.slice(c, 1, 1), F.slice(c, F.lit(3), n))
    elif scenario == "PA-03":
        new = F.concat(F.slice(c, 1, 1), F.array(sign(at(2), payload_digest=_marked("inserted", o))), F.slice(c, F.lit(2), n))
    elif scenario == "PA-04":
        new = F.concat(F.slice(c, 1, 2), F.array(at(3).withField("previous_hash", sha(F.lit('{"evil_previous":2}')))), F.slice(c, F.lit(4), n))
    elif scenario == "PA-05":
        new = F.concat(F.array(sign(at(1), order_id=_other(o))), F.slice(c, F.lit(2), n))
    elif scenario == "PA-06":
        r = at(-1).ai_risk_reference
        more = F.least(r.risk_score.cast("decimal(4,2)") + F.lit(0.1).cast("decimal(4,2)"), F.lit(1).cast("decimal(4,2)")).cast("decimal(4,2)").cast("string")
        new = F.concat(F.slice(c, F.lit(1), n - 1), F.array(sign(at(-1), ai_risk_reference=r.withField("risk_score", more))))
    elif scenario == "PA-07":
        new = F.slice(c, F.lit(1), n - 1)
    elif scenario == "PA-08":
        empty = F.slice(c, 1, 0)

        def rekey(acc: Column, b: Column) -> Column:
            first = F.size(acc) == 0
            link = F.when(first, b.previous_hash).otherwise(F.try_element_at(acc, F.lit(-1)).block_hash)
            ref = F.when(b.ai_risk_reference.isNotNull(), b.ai_risk_reference.withField("order_id", _other(o)))
            return F.concat(acc, F.array(sign(b, order_id=_other(o), previous_hash=link, ai_risk_reference=ref)))

        new = F.aggregate(c, empty, rekey)
    elif scenario == "PA-09":
        ref = at(-1).ai_risk_reference.withField("order_id", _other(o))
        new = F.concat(c, F.array(sign(at(-1), order_id=_other(o), ai_risk_reference=ref)))
    else:
        raise ValueError(f"no scenario {scenario}")
    return new


def tamper(chains: DataFrame, *scenarios: str) -> DataFrame:
    """The chains after each of the scenarios, on copies. They need five blocks; ``expected_id``
    is the true id. A chain is built once, however many scenarios it goes through."""
    return tamper_as_named(chains.withColumn("scenario", F.explode(F.array(*[F.lit(x) for x in scenarios]))), *scenarios)


def tamper_as_named(chains: DataFrame, *scenarios: str) -> DataFrame:
    """The chains after the scenario that each row names; ``scenarios`` are those that occur."""
    c, o, s = F.col("chain"), F.col("expected_id"), F.col("scenario")
    new = None
    for x in scenarios:
        edited = _edited(c, o, x)
        new = F.when(s == x, edited) if new is None else new.when(s == x, edited)
    return chains.withColumn("declared", F.size(c)).withColumn("chain", new)


def first_broken_link(chain: Column) -> Column:
    """The first place whose index or link is wrong, from 0; null if all are right."""
    bad = F.filter(
        F.sequence(F.lit(1), F.size(chain)),
        lambda i: F.when(i == 1, F.element_at(chain, i).previous_hash.isNotNull()).otherwise(
            (F.element_at(chain, i).block_index != i - 1) | ~F.element_at(chain, i).previous_hash.eqNullSafe(F.try_element_at(chain, F.greatest(i - 1, F.lit(1))).block_hash)
        ),
    )
    return F.try_element_at(bad, F.lit(1)) - 1


def detect(checked: DataFrame) -> DataFrame:
    """Add ``detected`` and ``location``: the scenario's own evidence beside the head's failed checks."""
    c, o, s = F.col("chain"), F.col("expected_id"), F.col("scenario")
    head = F.element_at(c, -1)
    failed = ~F.expr(" AND ".join(CHECKS))
    broken = first_broken_link(c)
    own = (
        F.when(s == "PA-01", payload_of_reference(head.ai_risk_reference) != head.payload_digest)
        .when(s.isin("PA-02", "PA-03"), broken.isNotNull())
        .when(s == "PA-04", ~F.col("c2"))
        .when(s.isin("PA-05", "PA-08"), F.element_at(c, 1).order_id != o)
        .when(s == "PA-06", ~F.col("c7"))
        .when(s == "PA-07", F.size(c) != F.col("declared"))
        .when(s == "PA-09", (head.order_id != o) | ~head.ai_risk_reference.order_id.eqNullSafe(o))
    )
    own = F.coalesce(own, F.lit(False))
    place = (
        F.when(~own, "head")
        .when(s == "PA-01", F.concat(F.lit("block "), F.size(c) - 1))
        .when(s.isin("PA-02", "PA-03"), F.concat(F.lit("block "), broken))
        .when(s == "PA-04", "block 2")
        .when(s == "PA-05", "genesis")
        .when(s == "PA-08", "chain")
        .when(s == "PA-07", F.concat(F.lit("end "), F.size(c)))
        .otherwise("head")
    )
    return checked.withColumn("detected", failed | own).withColumn("location", place)


# ledger


def transaction_hash(fields: dict[str, Column]) -> Column:
    return sha(canonical_json(**fields))


def ledger(transactions: DataFrame, position: str, digest: str, size: int = 8) -> DataFrame:
    """(block_id, n, tx_root, first, last): transactions in order, ``size`` a block.

    A block's root covers its transactions' digests. The position is a column of the data,
    from 0 without gaps, so blocks are groups and no task sees all rows.
    """
    rows = transactions.withColumn("block_id", (F.floor(F.col(position) / size) + 1).cast("long"))
    return rows.groupBy("block_id").agg(
        F.count("*").alias("n"),
        sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(digest)))), lambda x: x[digest]), "|")).alias("tx_root"),
        F.min(position).alias("first"),
        F.max(position).alias("last"),
    )


def link_ledger(blocks: DataFrame, ledger_of: int = 64) -> DataFrame:
    """Add ledger_id, previous_hash and block_hash: blocks are linked within ledgers of ``ledger_of`` blocks.

    Each ledger starts at a genesis of its own number, so ledgers are folded side by side.
    """
    rows = blocks.withColumn("ledger_id", F.floor((F.col("block_id") - 1) / ledger_of).cast("long"))
    genesis = lambda l: sha(F.concat(F.lit("genesis|"), l.cast("string")))
    listed = rows.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "n", "tx_root", "first", "last"))).alias("bs"))
    kind = "array<struct<block_id:bigint,n:bigint,tx_root:string,first:bigint,last:bigint,previous_hash:string,block_hash:string>>"

    def add(acc: Column, b: Column) -> Column:
        before = F.when(F.size(acc) == 0, genesis(F.col("ledger_id"))).otherwise(F.try_element_at(acc, F.lit(-1)).block_hash)
        link = F.struct(
            b.block_id.alias("block_id"), b.n.alias("n"), b.tx_root.alias("tx_root"), b.first.alias("first"), b["last"].alias("last"), before.alias("previous_hash"),
            sha(F.concat_ws("|", b.block_id.cast("string"), before, b.tx_root)).alias("block_hash"),
        )
        return F.concat(acc, F.array(link))

    return listed.select("ledger_id", F.inline(F.aggregate("bs", F.array().cast(kind), add)))


def verify_ledger(linked: DataFrame, roots: DataFrame) -> DataFrame:
    """(block_id, content_ok, hash_ok, link_ok) against roots (block_id, tx_root) computed anew."""
    again = roots.select(F.col("block_id").alias("b"), F.col("tx_root").alias("root"))
    w = Window.partitionBy("ledger_id").orderBy("block_id")
    before = F.coalesce(F.lag("block_hash").over(w), sha(F.concat(F.lit("genesis|"), F.col("ledger_id").cast("string"))))
    return linked.withColumn("link_ok", F.col("previous_hash") == before).join(again, F.col("block_id") == F.col("b")).select(
        "block_id", (F.col("root") == F.col("tx_root")).alias("content_ok"),
        (sha(F.concat_ws("|", F.col("block_id").cast("string"), F.col("previous_hash"), F.col("root"))) == F.col("block_hash")).alias("hash_ok"), "link_ok",
    )


def ledger_seals(linked: DataFrame, fan: int = 64, levels: int = 5) -> DataFrame:
    """(level, part, n, digest): level 0 seals the head and the number of blocks of each ledger, each
    further level ``fan`` seals of the one below, in order.

    The seal at the top covers all blocks, so a ledger that is lost, added or moved shows,
    though its own links hold. No task gathers more than ``fan`` seals.
    """
    one = linked.groupBy(F.col("ledger_id").alias("part")).agg(F.count("*").alias("n"), F.max_by("block_hash", "block_id").alias("head"))
    rows = one.select(F.lit(0).alias("level"), "part", "n", sha(F.concat_ws("|", F.col("part").cast("string"), F.col("n").cast("string"), "head")).alias("digest"))
    out = rows
    for level in range(1, levels):
        listed = F.array_sort(F.collect_list(F.struct("part", "digest")))
        rows = rows.groupBy(F.floor(F.col("part") / fan).cast("long").alias("up")).agg(
            F.sum("n").alias("n"), sha(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x.part.cast("string"), x.digest)), "|")).alias("digest")
        )
        rows = rows.select(F.lit(level).alias("level"), F.col("up").alias("part"), "n", "digest")
        out = out.unionByName(rows)
    return out


def verify_seals(linked: DataFrame, seals: DataFrame, fan: int = 64, levels: int = 5) -> DataFrame:
    """(level, part, ok): whether each seal still comes out of the blocks; a part that is on one side only is not ok."""
    now = ledger_seals(linked, fan, levels).select("level", "part", F.struct("n", "digest").alias("now"))
    then = seals.select("level", "part", F.struct("n", "digest").alias("then"))
    return now.join(then, ["level", "part"], "full_outer").select("level", "part", F.coalesce(F.col("now") == F.col("then"), F.lit(False)).alias("ok"))


def global_root(heads: DataFrame, key: str, digest: str) -> DataFrame:
    """One row (root, n): digests of buckets of keys, then the digest of these. Buckets bound what a task gathers."""
    rows = heads.select(F.sha2(F.col(key).cast("string"), 256).alias("k"), F.concat_ws(":", F.col(key).cast("string"), F.col(digest)).alias("x"))
    per = rows.groupBy(F.substring("k", 1, 3).alias("bucket")).agg(sha(F.array_join(F.array_sort(F.collect_list("x")), ",")).alias("d"), F.count("*").alias("n"))
    return per.agg(sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x.d), ",")).alias("root"), F.sum("n").alias("n"))
