"""Cart abandonment as keyed streaming state (one state per logged-in user), in event order.

Events may arrive in any order inside the watermark. They wait in the state until the watermark has passed
them and go to the cart by (event_time, id): the cart sees the same sequence whatever the arrival, so a late
file cannot move its clock back. A user is looked at once per micro-batch, when events arrive or when the
user's one timer fires: everything up to the watermark goes to the cart, and the timer is set for the next
moment at which something can happen, the next waiting event or the abandonment. The state is read and
written once for that. Of a user with more than ``FEW`` waiting events these lie by hours in a map of
their own, so they never have to fit a task's memory at once. The batch equivalent is
``operators.carts.abandoned_carts`` over the events up to the last watermark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.exprs import is_present
from ..schema import ABANDON_MINUTES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT_SCHEMA = ("user_id string, kind string, episode long, last_activity timestamp, notify_at timestamp, "
                 "cart_size long, events long, active long")
COLUMNS = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]
ROW_SCHEMA = OUTPUT_SCHEMA.replace("timestamp", "long")  # microseconds
WAITING = "at array<long>, id array<long>, kind array<string>, product array<string>"
FEW, HOUR = 10_000, 3_600_000_000


class Cart:
    """What is known of one user at a moment of event time (microseconds)."""

    def __init__(self, seen_at=None, told=False, episode=0, size=0):
        self.seen_at, self.told, self.episode, self.size = seen_at, told, episode, size

    def saved(self) -> tuple:
        return self.seen_at, self.told, self.episode, self.size

    def deadline(self, gap: int) -> int | None:
        """When the cart counts as abandoned, if nothing happens; None: never."""
        return self.seen_at + gap if self.size and not self.told else None

    def abandoned_by(self, now: int, gap: int) -> tuple | None:
        """The abandonment that time ``now`` brings about, once per episode."""
        due = self.deadline(gap)
        if due is None or now <= due:
            return None
        self.told = True
        return self.episode, self.seen_at, due, self.size


class Products(set):
    """A cart's products in memory, with the calls of a map state."""

    containsKey, removeKey = set.__contains__, set.remove

    def updateValue(self, key: tuple, _) -> None:
        self.add(key)


class CartKeeper(StatefulProcessor):
    """The plain form, which needs no watermark at hand: a timer per waiting millisecond and possible
    abandonment. ``CartsByWatermark`` gives the same with one timer per user.

    State: ``waiting`` (millisecond -> its events), ``products`` (product -> nothing) and ``cart``."""

    def __init__(self, minutes: int):
        self.gap = minutes * 60_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", WAITING)
        self.products = handle.getMapState("products", "product string", "present boolean")
        self.cart = handle.getValueState("cart", "seen_at long, told boolean, episode long, size long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in rows:
            n += len(pdf)
            pdf = pdf.assign(at=pdf["event_time"].astype("datetime64[us]").astype("int64"))
            pdf["product"] = [p.strip() if isinstance(p, str) else "" for p in pdf["product_id"]]
            for ms, some in pdf.groupby(-(-pdf["at"] // 1000)):  # the millisecond in which the watermark passes it
                entry = [some[c].tolist() for c in ("at", "id", "event_type", "product")]
                there = self.waiting.getValue((int(ms),))
                if there:
                    entry = [list(old) + new for old, new in zip(there, entry)]
                self.handle.registerTimer(int(ms))
                for at in entry[0]:
                    self.handle.registerTimer((at + self.gap) // 1000 + 1)
                self.waiting.updateValue((int(ms),), tuple(entry))
        yield frame(key[0], [("seen", None, None, None, None, n, None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        before, events = self.cart.get(), self.waiting.getValue((ms,))
        cart = Cart(*before) if before else Cart()
        had, found = cart.size > 0, []
        if events:
            for at, _, kind, product in sorted(zip(*events)):
                found.append(cart.abandoned_by(at, self.gap))
                take(cart, self.products, at, kind, product)
            self.waiting.removeKey((ms,))
        if cart.seen_at is not None:
            found.append(cart.abandoned_by(ms * 1000, self.gap))
        if cart.saved() != before:
            self.cart.update(cart.saved())
        rows = [("abandoned", *f, None, None) for f in found if f]
        if had != (cart.size > 0):
            rows.append(("cart", None, None, None, None, None, -1 if had else 1))
        if rows:
            yield frame(key[0], rows)

    def close(self) -> None:
        pass


def take(cart: Cart, products, at: int, kind: str, product: str) -> None:
    """An event reaches the cart; ``products`` is a map state or ``Products``."""
    cart.seen_at = at
    if kind == "transaction":
        products.clear()
        cart.size = 0
    elif not product or kind not in ("add_to_cart", "delete_from_cart"):
        return
    else:
        there = products.containsKey((product,))
        if kind == "delete_from_cart":
            if there:
                products.removeKey((product,))
                cart.size -= 1
            return
        if not there:
            products.updateValue((product,), (True,))
            cart.size += 1
    cart.told, cart.episode = False, cart.episode + 1  # a new episode may be told again


class CartsByWatermark(StatefulProcessor):
    """Rows (at, id, event_type, product_id) of a user -> rows of ROW_SCHEMA.

    State: ``user`` (the cart, its products, the timer, few waiting events or the hours of many) and
    ``hours`` (hour -> its waiting events)."""

    def __init__(self, minutes: int):
        self.gap = minutes * 60_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", "seen_at long, told boolean, episode long, size long, timer long, products array<string>, "
                                                 f"hours array<long>, {WAITING}")
        self.hours = handle.getMapState("hours", "hour long", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cart, timer, products, hours, waiting = self.known()
        n = 0
        while part := [(r.at, r.id, r.event_type, (r.product_id or "").strip()) for r in islice(rows, FEW)]:
            n += len(part)
            waiting += part
            if hours or len(waiting) > FEW:
                self.put_by_hour(waiting, hours)
                waiting = []
        yield row(key[0], ("seen", None, None, None, None, n, None))
        yield from self.advance(key[0], cart, timer, products, hours, waiting, timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key[0], *self.known(), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def known(self) -> tuple:
        there = self.user.get()
        if not there:
            return Cart(), None, Products(), set(), []
        seen_at, told, episode, size, timer, products, hours, *waiting = there
        return Cart(seen_at, told, episode, size), timer, Products((p,) for p in products), set(hours), list(zip(*waiting))

    def put_by_hour(self, events: list[tuple], hours: set) -> None:
        by_hour: dict[int, list] = {}
        for e in events:
            by_hour.setdefault(e[0] // HOUR, []).append(e)
        for hour, own in by_hour.items():
            if hour in hours:
                own = [*zip(*self.hours.getValue((hour,))), *own]
            self.hours.updateValue((hour,), columns(own))
            hours.add(hour)

    def due(self, hours: set, waiting: list[tuple], now: int) -> Iterator[tuple]:
        """The waiting events up to ``now`` in order, taken out of the hours; ``waiting`` stays as it is."""
        yield from sorted(e for e in waiting if e[0] <= now)
        for hour in sorted(h for h in hours if h * HOUR <= now):
            events = sorted(zip(*self.hours.getValue((hour,))))
            later = [e for e in events if e[0] > now]
            if later:
                self.hours.updateValue((hour,), columns(later))
            else:
                self.hours.removeKey((hour,))
                hours.remove(hour)
            yield from events[:len(events) - len(later)]

    def advance(self, user: str, cart: Cart, timer: int | None, products: Products, hours: set, waiting: list[tuple], mark: int,
                fired: int | None) -> Iterator[Row]:
        """What the watermark ``mark`` (milliseconds) brings about; the state and the timer after it."""
        now, had = mark * 1000, cart.size > 0
        for at, _, kind, product in self.due(hours, waiting, now):
            if told := cart.abandoned_by(at, self.gap):
                yield row(user, ("abandoned", *told, None, None))
            take(cart, products, at, kind, product)
        if told := cart.abandoned_by(now, self.gap):
            yield row(user, ("abandoned", *told, None, None))
        if had != (cart.size > 0):
            yield row(user, ("cart", None, None, None, None, None, -1 if had else 1))
        waiting = [e for e in waiting if e[0] > now]
        nexts = [-(-e[0] // 1000) for e in waiting] + [max(mark + 1, h * HOUR // 1000) for h in hours]
        if (deadline := cart.deadline(self.gap)) is not None:
            nexts.append(deadline // 1000 + 1)
        after = min(nexts, default=None)
        if after != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        self.user.update((*cart.saved(), after, [p for p, in products], list(hours), *columns(waiting)))

    def close(self) -> None:
        pass


def columns(events: list[tuple]) -> tuple:
    return tuple([e[k] for e in events] for k in range(4))


def row(user: str, values: tuple) -> Row:
    return Row(*COLUMNS)(user, *values)


def frame(user: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(user, *r) for r in rows], columns=COLUMNS)
    for c in ("last_activity", "notify_at"):
        out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us").astype("datetime64[us]")
    return out.astype({c: "Int64" for c in ("episode", "cart_size", "events", "active")})


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store; queries that started with another one keep it
    (the checkpoint says which)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def notifier_stream(user_events: DataFrame, minutes: int = ABANDON_MINUTES) -> DataFrame:
    """Append-mode stream of what the notifier does, from a watermarked stream of user events:
    ``seen`` (``events`` that arrived), ``cart`` (``active``: +1 a cart got its first product, -1 it is
    empty again) and ``abandoned`` (episode, last_activity, notify_at, cart_size)."""
    use_rocksdb(user_events.sparkSession)
    ev = user_events.filter(is_present("user_id")).select(
        "user_id", "id", "event_time", F.unix_micros("event_time").alias("at"), "event_type", "product_id")
    rows = ev.groupBy("user_id").transformWithState(CartsByWatermark(minutes), ROW_SCHEMA, "Append", "EventTime")
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("last_activity", "notify_at")})


def abandoned_only(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'abandoned'").select("user_id", "episode", "last_activity", "notify_at", "cart_size")


def abandoned_carts_stream(user_events: DataFrame, minutes: int = ABANDON_MINUTES) -> DataFrame:
    """Append-mode stream of abandonments from a watermarked stream of user events."""
    return abandoned_only(notifier_stream(user_events, minutes))


def with_ntz(df: DataFrame) -> DataFrame:
    return (df.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))
              .withColumn("notify_at", F.col("notify_at").cast("timestamp_ntz")))
