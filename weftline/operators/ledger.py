"""A ledger of credits with expiry, and pricing: balances, intervals, tiers, discounts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold
from .ranges import scan

#: The bucket of credits that never expire.
NEVER = 1 << 62


def _after(state: Column, credits: Column, expires: Column, at: Column) -> Column:
    """The open buckets ``{b: [{e: expiry, v: credits}], over}`` behind an entry: credits fill the bucket of their expiry, debits
    empty the earliest ones that haven't expired. What no bucket covers is ``over``; buckets that nothing will use go.
    """
    bucket = lambda e, v: F.struct(e.alias("e"), v.alias("v"))
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (evaluated once, however often it is read)

    def filled(b: Column) -> Column:
        same = F.aggregate(b, credits, lambda n, x: F.when(x["e"] == expires, n + x["v"]).otherwise(n))
        return F.concat(F.filter(b, lambda x: x["e"] < expires), F.array(bucket(expires, same)), F.filter(b, lambda x: x["e"] > expires))

    def drained(b: Column) -> Column:
        # Buckets lie by expiry: the first ``i`` are emptied, the next one gives what is left. No array grows on the way.
        start = F.struct((-credits).alias("n"), F.lit(0).alias("i"), F.lit(True).alias("on"))
        one = lambda l, x: F.when(l["on"] & (l["n"] >= x["v"]), F.struct((l["n"] - x["v"]).alias("n"), (l["i"] + 1).alias("i"), l["on"].alias("on"))).otherwise(
            F.struct(l["n"].alias("n"), l["i"].alias("i"), F.lit(False).alias("on")))
        rest = lambda l: F.when(l["i"] >= F.size(b), F.struct(F.slice(b, 1, 0).alias("b"), (state["over"] + l["n"]).alias("over"))).otherwise(F.struct(F.concat(
            F.array(bucket(F.get(b, l["i"])["e"], F.get(b, l["i"])["v"] - l["n"])), F.slice(b, l["i"] + 2, F.size(b))).alias("b"), state["over"].alias("over")))
        return let(F.aggregate(b, start, one), rest)

    open_ = F.filter(state["b"], lambda x: (x["e"] >= at) & (x["v"] > 0))
    return let(open_, lambda b: F.when(credits >= 0, F.struct(filled(b).alias("b"), state["over"].alias("over"))).otherwise(drained(b)))


def balance(entries: DataFrame, day: int, keys: tuple[str, ...] = ("wallet", "product"), at: str = "valid_from", expires: str = "expired_at", credits: str = "credits", tie: str = "id") -> DataFrame:
    """The balance of each key on a day: entries valid by then, in their order, first to expire first used.

    ``valid_from`` and ``expired_at`` are day numbers. An ordered fold within the JVM (see ``fold.ordered_fold``) whose state is
    the open buckets, one for each expiry; debits that no bucket covers are an overdraft that later credits don't lift.
    """
    live = entries.where((F.col(at) <= day) & (F.col(credits) != 0))
    live = live.select(*keys, F.col(at).cast("long").alias("__at"), F.col(tie).alias("__tie"), F.col(credits).cast("long").alias("__credits"), F.coalesce(F.col(expires).cast("long"), F.lit(NEVER)).alias("__expires"))
    zero = F.expr("named_struct('b', cast(array() as array<struct<e: bigint, v: bigint>>), 'over', 0L)")
    step = lambda state, row: _after(state, row["__credits"], row["__expires"], row["__at"])
    done = ordered_fold(live, list(keys), ["__at", "__tie"], ["__credits", "__expires"], zero, step)
    left = F.aggregate(F.filter("state.b", lambda x: x["e"] >= day), F.lit(0).cast("long"), lambda n, x: n + x["v"])
    return done.select(*keys, (left - F.col("state.over")).alias("balance"))


def may_use(balances: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with ``allowed``: whether the balance covers the amount."""
    return requests.join(balances, keys, "left").withColumn("allowed", F.coalesce(F.col("balance") >= F.col("amount"), F.lit(False)))


def transfer(requests: DataFrame) -> DataFrame:
    """Two entries for each transfer: a debit of one wallet, a credit of the other."""
    out = F.struct(F.col("source").alias("wallet"), (-F.col("amount")).alias("credits"))
    into = F.struct(F.col("target").alias("wallet"), F.col("amount").alias("credits"))
    return requests.withColumn("__e", F.explode(F.array(out, into))).select("*", "__e.wallet", "__e.credits").drop("__e", "source", "target", "amount")


def accessible(wallets: DataFrame, members: DataFrame, user: Column | int, owner: str = "user_id") -> DataFrame:
    """Wallets that a user owns or is a member of."""
    own = members.where(F.col("user_id") == user).select(F.col("wallet_id").alias("id"))
    mine = wallets.where(F.col(owner) == user)
    return mine.unionByName(wallets.where(~F.coalesce(F.col(owner) == user, F.lit(False))).join(own, "id", "left_semi"))


def new_entries(entries: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Entries whose key isn't known yet, one of each."""
    return entries.join(known.select(key), key, "left_anti").dropDuplicates([key])


def refund(entries: DataFrame, at: Column, start: str = "valid_from", expires: str = "expired_at") -> DataFrame:
    """Entries that would begin after the refund go; open ones end with it."""
    return entries.where(F.col(start) <= at).withColumn(expires, F.when(F.col(expires).isNull() | (F.col(expires) > at), at).otherwise(F.col(expires)))


def intervals(rows: DataFrame, start: str, end: str, months: int = 0, days: int = 0, seconds: int = 0) -> DataFrame:
    """Consecutive intervals of each row's range. By months, those that lack the start's day of the month are skipped."""
    step = F.make_interval(months=F.lit(months), days=F.lit(days), secs=F.lit(seconds))
    dates = F.sequence(F.col(start), F.col(end), step)
    if months:
        dates = F.filter(dates, lambda d: F.day(d) == F.day(F.col(start)))
    pairs = F.zip_with(dates, F.slice(dates, 2, 1 << 30), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return rows.withColumn("__i", F.explode(F.filter(pairs, lambda p: p["to"].isNotNull()))).select("*", F.col("__i.from").alias("interval_from"), F.col("__i.to").alias("interval_to")).drop("__i")


# The units of a frequency.
_UNITS = {"M": ("months", 1), "W": ("days", 7), "D": ("days", 1), "Y": ("months", 12), "h": ("seconds", 3600), "m": ("seconds", 60), "s": ("seconds", 1)}


def frequency(text: str) -> dict[str, int]:
    """Arguments of ``intervals`` for a number and a unit: ``3M``, ``2W``, ``1D``, ``1Y``, ``6h``, ``30m``, ``10s``."""
    found = re.fullmatch(r"([1-9]\d*)([MWDYhms])", text)
    if not found:
        raise ValueError(f"not a frequency: {text!r}")
    name, many = _UNITS[found[2]]
    return {name: int(found[1]) * many}


def tiered(lines: DataFrame, tiers: DataFrame, quantity: str = "quantity", product: str = "product", volume: bool = False) -> DataFrame:
    """Line items by tier: ``units`` in each tier up to the covering one, and their ``amount`` with the tier's flat fee.

    ``tiers`` has ``product, last_unit (NULL: open), per_unit, flat_fee``. Graduated by default: each tier takes its own
    units. With ``volume`` the whole quantity is priced by the first tier that covers it.
    """
    w = Window.partitionBy(product).orderBy(F.col("last_unit").asc_nulls_last())
    steps = tiers.withColumn("__before", F.coalesce(F.lag("last_unit").over(w), F.lit(0)))
    rows = lines.join(steps, product).where((F.col(quantity) > F.col("__before")) | ((F.col(quantity) == 0) & (F.col("__before") == 0)))
    q = F.least(F.col(quantity), F.coalesce("last_unit", F.col(quantity)))
    if volume:
        rows = rows.where(F.col("last_unit").isNull() | (F.col(quantity) <= F.col("last_unit")))
        units = F.col(quantity)
    else:
        units = q - F.col("__before")
    return rows.withColumn("units", units).withColumn("amount", units * F.col("per_unit") + F.col("flat_fee")).drop("__before")


def discounted(lines: DataFrame, discounts: DataFrame, product: str = "product", amount: str = "amount", order: str = "line") -> DataFrame:
    """Line amounts after discounts: percentages of a product multiply, flat ones are a budget its lines use up in order."""
    rules = discounts.groupBy(product).agg(F.coalesce(F.sum("flat"), F.lit(0)).alias("flat"), F.coalesce(F.product(1 - F.coalesce("percent", F.lit(0)) / 100), F.lit(1.0)).alias("factor"))
    rows = lines.join(rules, product, "left").withColumns({"flat": F.coalesce("flat", F.lit(0)), "factor": F.coalesce("factor", F.lit(1.0))})
    rows = rows.withColumn("__net", F.col(amount) * F.col("factor"))
    rows = scan(rows, [product], [order], {"__upto": F.col("__net")})
    left = F.greatest(F.col("flat") - (F.col("__upto") - F.coalesce("__net", F.lit(0.0))), F.lit(0.0))
    return rows.withColumn("net", F.ceil(F.round(F.greatest(F.col("__net") - left, F.lit(0.0)), 6)).cast("long")).drop("__net", "__upto", "flat", "factor")


def priced(lines: DataFrame, prices: DataFrame, key: str = "lookup_key") -> DataFrame:
    """Lines with the price of their lookup key."""
    return lines.join(prices, key, "left")


def usage_allowed(new: Column, previous: Column, force: Column) -> Column:
    """A usage may be lowered, or set at will by force."""
    return force | (new <= previous)
