"""Stateful processors: load the states of a bucket of keys, apply the kernel per key, store them.

A call into the state store and an Arrow batch per key cost far more than a
message, so keys share their state in ``BUCKETS`` buckets by hash: one call
reads and one writes the states of a bucket, whose number stays the same for
the life of a checkpoint.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tillflow import vocabulary as v
from tillflow.streaming import kernels

OUTCOMES = "value string, us bigint, seq bigint, rule string, outcome string, extra string, text string"
OUTCOME = namedtuple("Outcome", "value us seq rule outcome extra text")
BUCKETS = 4096
# the states of a bucket, as JSON text by key
HELD = "ids array<string>, states array<string>"
STATE = "entities"


# rule and outcome of records that no service can read; they have keys of their own and no state
QUARANTINE = "quarantine"


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def bucketed(snapshot: DataFrame) -> DataFrame:
    """States to start from (``key`` and a state's columns), one row a bucket."""
    rest = F.to_json(F.struct(*[c for c in snapshot.columns if c != "key"]))
    entry = F.struct(F.col("key").alias("id"), rest.alias("state"))
    return snapshot.groupBy(bucket("key").alias("bucket")).agg(F.collect_list(entry).alias("entries")).select(
        "bucket", F.col("entries.id").alias("ids"), F.col("entries.state").alias("states"))


class Compact:
    """Writes JSON text without spaces. ``json.dumps`` makes an encoder for every value, which takes longer than the
    writing; here a process makes one, as it does not travel with a task."""

    def __init__(self):
        made, in_c = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False), json.encoder.c_make_encoder
        self.chunks = made.iterencode if in_c is None else in_c(
            None, made.default, json.encoder.encode_basestring, None, made.key_separator, made.item_separator, False, False, True)

    def __call__(self, value) -> str:
        return "".join(self.chunks(value, 0))

    def __reduce__(self):
        return Compact, ()


class Parsed:
    """What ``json.loads`` gives for a text that ``to_json`` or ``Compact`` wrote, with no space around the value."""

    def __init__(self):
        self.scan = json.JSONDecoder().scan_once

    def __call__(self, text: str):
        return self.scan(text, 0)[0]

    def __reduce__(self):
        return Parsed, ()


compact, parsed = Compact(), Parsed()


EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class Message:
    """What a kernel sees of a record; columns that are NULL are None."""

    text = user_id = order_id = item_id = price = code = note = results = us = seq = None

    def __init__(self, record: dict, value: str):
        self.__dict__.update(record)
        self.value = value

    @property
    def ts(self):
        return None if self.us is None else EPOCH + dt.timedelta(microseconds=self.us)

    def parts(self, name):
        """One field of the results per item, as a list."""
        return None if self.results is None else [(r.get("value") or {}).get(name) for r in self.results]

    @property
    def items(self):
        return None if self.results is None else [r["key"] for r in self.results]

    @property
    def codes(self):
        return self.parts("state")

    @property
    def amounts(self):
        return self.parts("amount")


def arrival(m):
    return m.us is None, m.us or 0, m.seq is None, m.seq or 0


class Bucketed(StatefulProcessor):
    """Holds the states of a bucket of keys as JSON text by key."""

    def init(self, handle):
        self.handle = handle
        self.entities = handle.getValueState(STATE, HELD)
        self.timer = handle.getValueState("timer", "ms bigint")

    def held(self) -> dict:
        found = self.entities.get()
        return dict(zip(*found)) if found else {}

    def keep(self, before: dict, after: dict) -> None:
        """Write a bucket only where it changed; an empty one is removed."""
        if after == before:
            return
        if after:
            self.entities.update((list(after), list(after.values())))
        else:
            self.entities.clear()

    def wake(self, due: int) -> None:
        """A bucket has one timer, for the first of its keys that is due."""
        found = self.timer.get()
        if not found or due < found[0]:
            self.timer.update((due,))
            self.handle.registerTimer(due)

    def wake_next(self, dues) -> None:
        """After a timer has fired: the next one."""
        self.timer.clear()
        due = min(dues, default=None)
        if due is not None:
            self.wake(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter([])

    def close(self):
        pass


def passed_by(timer_values, timer_info) -> int:
    """The newest millisecond that the watermark has passed when a timer fires."""
    return max(timer_info.getExpiryTimeInMs(), timer_values.getCurrentWatermarkInMs() - 1)


class Keyed(Bucketed):
    """Applies the messages of every key of a bucket in the order (ts, seq).

    ``load`` takes the state of a key as JSON has it, None if there is none;
    ``store`` gives it back.
    """

    def handleInitialState(self, key, initialState, timerValues):
        held = {}
        for id_, state in zip(initialState.ids, initialState.states):
            held[id_] = compact(self.merged(parsed(held[id_]), parsed(state))) if id_ in held else state
        self.entities.update((list(held), list(held.values())))

    @staticmethod
    def merged(first, more):
        """The state of a key that the snapshot has twice."""
        return more

    def handleInputRows(self, key, rows, timerValues):
        before = self.held()
        after, messages, dues = dict(before), {}, []
        for m in sorted([Message(parsed(r.record), r.value) for r in rows], key=arrival):
            messages.setdefault(m.key, []).append(m)
        for id_, mine in messages.items():
            was = parsed(before[id_]) if id_ in before else None
            self.load(id_, was)
            for m in mine:
                yield from self.answered(id_, m)
            state = self.store(id_)
            if state is not None:
                after[id_] = compact(state)
                dues.append(self.due(state))
            elif was is not None and self.known(was):
                del after[id_]
        self.keep(before, after)
        due = min((d for d in dues if d is not None), default=None)
        if due is not None:
            self.wake(due)

    @staticmethod
    def known(state) -> bool:
        """False for an entry of the snapshot that holds nothing; it stays as it is."""
        return True

    def due(self, state) -> int | None:
        """When the key wants to be woken, in milliseconds."""
        return None

    def answered(self, id_, m):
        if m.rule == QUARANTINE:
            answers = [(QUARANTINE, {}, m.text)]
        elif m.rule == "unknown":
            known_route = m.text is not None
            answers = [("refused" if known_route else "unknown_route", {}, m.text)]
        else:
            try:
                answers = self.apply(id_, m)
            except Exception as e:  # noqa: BLE001 - one bad message must not end the job
                # kernels look everything up before they change anything, so the state is as it was
                answers = [("refused", {}, f"{v.UNMANAGED}{type(e).__name__}: {e}")]
        for outcome, extra, text in answers:
            yield self.row(m.value, m.us, m.seq, m.rule, outcome, extra, text)

    @staticmethod
    def row(value, us, seq, rule, outcome, extra, text):
        return OUTCOME(value, us, seq, rule, outcome, compact(extra), text)


class InFrames(StatefulProcessor):
    """Runs a processor of rows on data frames: one frame of a key's rows in, one out.

    Spark hands rows over value by value and writes an Arrow batch in Python for each
    of their dictionaries; columns cross at once. Null numbers would become floats in a
    column, so ``columns``, which are all that the processor gets, have none.
    """

    def __init__(self, processor: StatefulProcessor, columns: list[str], out: str):
        self.processor, self.columns = processor, columns
        self.names = [c.split()[0] for c in out.split(", ")]

    def init(self, handle):
        self.given = namedtuple("Given", self.columns)
        self.processor.init(handle)

    def handleInitialState(self, key, initialState, timerValues):
        for ids, states in zip(initialState["ids"], initialState["states"]):
            self.processor.handleInitialState(key, Row(ids=ids, states=states), timerValues)

    def handleInputRows(self, key, rows, timerValues):
        given = (row for frame in rows for row in map(self.given, *[frame[c].tolist() for c in self.columns]))
        return self.frame(self.processor.handleInputRows(key, given, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self.frame(self.processor.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def frame(self, rows) -> Iterator[pd.DataFrame]:
        rows = list(rows)
        if rows:
            # one block for all columns: a series for each takes longer than the rows of a small bucket
            cells = np.empty((len(rows), len(self.names)), dtype=object)
            cells[:] = rows
            yield pd.DataFrame(cells, columns=self.names, dtype=object)

    def close(self):
        self.processor.close()


class UserProcessor(Keyed):
    """Balance and owned orders of a user; the orders are only read for a view."""

    @staticmethod
    def merged(first, more):
        return {**more, "orders": sorted({*(first.get("orders") or []), *(more.get("orders") or [])})}

    @staticmethod
    def known(state):
        return state.get("credits") is not None

    def load(self, key, state):
        self.balance = state.get("credits") if state else None
        self.orders = set(state.get("orders") or []) if state else set()

    def owned(self):
        return sorted(self.orders)

    def apply(self, key, m):
        verb = kernels.VERBS[m.rule]
        amount = (m.price if m.price is not None else 0) if verb in ("charge", "refund") else m.amount
        self.balance, outcome = kernels.move(self.balance, verb, amount)
        if outcome == "ok" and m.rule == "orders/create":
            self.orders.add(m.order_id)
        if outcome == "ok" and m.rule == "orders/remove":
            self.orders.discard(m.order_id)
        extra = kernels.user_extra(m.rule, verb, outcome, self.balance, lambda: {
            "user_id": key, "balance": self.balance, "orders": f"[{', '.join(self.owned())}]"})
        answers = [(outcome, extra, None)]
        if verb == "close" and outcome == "ok":
            answers = [("order", {"order_id": o}, None) for o in self.owned()] + answers
            self.orders = set()
        return answers

    def store(self, key):
        if self.balance is None:
            return None
        return {"credits": self.balance, **({"orders": self.owned()} if self.orders else {})}


class StockProcessor(Keyed):
    @staticmethod
    def known(state):
        return state.get("amount") is not None

    def load(self, key, state):
        self.amount = state.get("amount") if state else None

    def apply(self, key, m):
        was = self.amount
        self.amount, outcome = kernels.move(was, kernels.VERBS[m.rule], m.amount)
        return [(*kernels.stock_answer(m.rule, key, was, self.amount, outcome, m.amount), None)]

    def store(self, key):
        return None if self.amount is None else {"amount": self.amount}


class PaymentProcessor(Keyed):
    def load(self, key, state):
        self.state = (state["status"], state["price"]) if state else None

    def apply(self, key, m):
        self.state, answers = kernels.payment_step(self.state, key, m)
        return answers

    def store(self, key):
        return dict(zip(("status", "price"), self.state)) if self.state else None


# other messages leave the basket, and so its text, as it is
CHANGES_BASKET = ("orders/create", "orders/remove", "orders/addItem", "orders/removeItem")


class OrderProcessor(Keyed):
    """Order state, and a timer per bucket for its running checkouts.

    The basket is JSON text, as the snapshot has it. ``held`` and ``log`` are
    what a running checkout holds and has logged, ``waiting`` the request
    (value, us, seq) that its timeout is told.
    """

    def __init__(self, timers: bool):
        self.timers = timers

    @staticmethod
    def merged(first, more):
        """One row per order; baskets of several rows are merged, whatever their order."""
        baskets = [json.loads(s.get("products") or "{}") for s in (first, more)]
        return {**more, "products": compact({**baskets[0], **baskets[1]})}

    def load(self, key, state):
        self.order = self.waiting = self.basket = None
        if state:
            self.waiting = state.get("waiting")
        if state and set(state) != {"waiting"}:
            running = state.get("checkout_status") == v.IN_PROGRESS
            self.basket = state.get("products")
            self.order = kernels.Order(
                state.get("user_id"), state.get("user_checked"), state.get("is_paid"), state.get("checkout_status"),
                state.get("progress", 0), json.loads(state.get("products") or "{}"),
                state.get("held", {}) if running else {}, [tuple(e) for e in state.get("log", [])] if running else [])

    def apply(self, key, m):
        if m.rule.startswith(CHANGES_BASKET):
            self.basket = None
        self.order, answers = kernels.order_step(self.order, key, m)
        if self.timers and any(a[0] == "take" for a in answers):
            self.waiting = [m.value, m.us, m.seq]
        return answers

    def store(self, key):
        o = self.order
        if o is None and not self.waiting:
            return None
        head = {} if o is None else {
            "user_id": o.user_id, "user_checked": o.checked, "is_paid": o.paid, "checkout_status": o.status,
            "products": self.basket or compact(o.products), "progress": o.progress or None, "held": o.held, "log": [list(e) for e in o.log]}
        return {k: x for k, x in {**head, "waiting": self.waiting}.items() if x not in (None, {}, [])}

    def due(self, state):
        if not self.timers or "waiting" not in state:
            return None
        return state["waiting"][1] // 1000 + v.CHECKOUT_TIMEOUT_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, before = passed_by(timerValues, expiredTimerInfo), self.held()
        after, dues = dict(before), []
        for id_, text in before.items():
            due = self.due(state := parsed(text))
            if due is None or due > now:
                dues += [] if due is None else [due]
                continue
            self.load(id_, state)
            value, us, seq = self.waiting
            self.order, answers = kernels.order_expired(self.order, id_)
            self.waiting = None
            left = self.store(id_)
            if left is None:
                del after[id_]
            else:
                after[id_] = compact(left)
            for outcome, extra, text in answers:
                yield self.row(value, us, seq, "orders/checkout:-", outcome, extra, text)
        self.keep(before, after)
        self.wake_next(dues)


class FanInProcessor(StatefulProcessor):
    """Collects the answers of one batch by item; hands them on once, when all items are in.

    Of several answers for an item the latest counts. Every batch has a timer
    from the ``clock`` of its first answer on: it reports a batch that is
    incomplete by then, and forgets one that was handed on.
    """

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle):
        self.handle = handle
        self.passes = handle.getMapState("passes", "item_id string", "passed string")
        self.seen = handle.getValueState("seen", "n bigint, of bigint, value string, ts timestamp, seq bigint")
        self.done = handle.getValueState("done", "yes boolean")

    def handleInputRows(self, key, rows, timerValues):
        rows = sorted(rows, key=lambda r: (r.ts, r.seq, r.item_id or ""))
        if rows[0].reason is not None:  # unreadable ones have keys of their own
            for m in rows:
                yield Row(batch_id=None, value=m.value, ts=m.ts, seq=m.seq, complete=None, seen=0, products=m.reason)
            return
        if self.done.exists():
            return
        found = self.seen.get()
        n, of, value, ts, seq = found if found else (0, None, None, None, None)
        if not found:
            self.handle.registerTimer(millis(min(m.clock for m in rows)) + self.window_ms)
            of, value, ts, seq = rows[0].batch_count, rows[0].value, rows[0].ts, rows[0].seq
        passes = {m.item_id: m.passed for m in rows}
        n += sum(1 for item in passes if not (found and self.passes.containsKey((item,))))
        if n < of:  # only an incomplete batch is put into state
            for item, passed in passes.items():
                self.passes.updateValue((item,), (passed,))
            self.seen.update((n, of, value, ts, seq))
            return
        if found:
            passes = {**{k[0]: p[0] for k, p in self.passes.iterator()}, **passes}
            self.seen.clear()
            self.passes.clear()
        self.done.update((True,))
        yield Row(batch_id=key[0], value=value, ts=ts, seq=seq, complete=True, seen=n, products=in_order(passes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        found = self.seen.get()
        if found:
            n, of, value, ts, seq = found
            self.seen.clear()
            self.passes.clear()
            yield Row(batch_id=key[0], value=value, ts=ts, seq=seq, complete=False, seen=n, products=None)
        self.done.clear()

    def close(self):
        pass


class FanInBuckets(Bucketed):
    """What ``FanInProcessor`` does, for a bucket of batches at once.

    The state of a batch is when it is given up (in milliseconds) and, while it is not
    complete, what came of it: number, count, request (value, us, seq) and its items.
    """

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def handleInputRows(self, key, rows, timerValues):
        before = self.held()
        after, came, dues = dict(before), {}, []
        for r in rows:
            m = parsed(r.record)
            came.setdefault(m.get("batch_id"), []).append((m, r.value))
        for id_, mine in came.items():
            mine.sort(key=lambda p: (p[0].get("us"), p[0].get("seq"), p[0].get("item_id") or ""))
            head, value = mine[0]
            if head.get("reason") is not None:  # unreadable ones have keys of their own
                for m, text in mine:
                    yield FAN_IN_ROW(None, text, m.get("us"), m.get("seq"), None, 0, m["reason"])
                continue
            found = parsed(before[id_]) if id_ in before else None
            if found and len(found) == 1:  # handed on
                continue
            if not found:
                found = [min(m["clock"] for m, _ in mine) + self.window_ms, 0, head.get("batch_count"), value, head.get("us"), head.get("seq"), []]
                dues.append(found[0])
            due, _, of, value, us, seq, held = found
            # pairs, as the name of an item may be missing
            passes = {**dict(held), **{m.get("item_id"): m.get("passed") for m, _ in mine}}
            n = len(passes)
            if n < of:
                after[id_] = compact([due, n, of, value, us, seq, list(passes.items())])
                continue
            after[id_] = compact([due])
            yield FAN_IN_ROW(id_, value, us, seq, True, n, in_order(passes))
        self.keep(before, after)
        if dues:
            self.wake(min(dues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, before = passed_by(timerValues, expiredTimerInfo), self.held()
        after, dues = {}, []
        for id_, text in before.items():
            due, *rest = parsed(text)
            if due > now:
                after[id_] = text
                dues.append(due)
            elif rest:
                n, _, value, us, seq, _ = rest
                yield FAN_IN_ROW(id_, value, us, seq, False, n, None)
        self.keep(before, after)
        self.wake_next(dues)


def in_order(passes: dict) -> str:
    return "{" + ",".join(f"{json.dumps(item)}:{passed}" for item, passed in sorted(passes.items())) + "}"


class FirstAnswerProcessor(Bucketed):
    """One row per request: its first answer within the timeout, or that there was none.

    An answer is the first only once the watermark has passed it, since an
    earlier one may still come; a timer waits for that, or for the deadline.
    Answers without request are kept as long as a request for them may come.
    A request's state is when it was asked, its first answer, and the answers
    that came before it, in microseconds, which no time zone touches.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def deadline(self, us: int) -> int:
        """In milliseconds, rounded up."""
        return -(-us // 1000) + self.timeout_ms

    def due(self, asked, first, early) -> int:
        if asked is None:
            return self.deadline(max(early))
        return self.deadline(asked) if first is None else -(-first // 1000)

    def handleInputRows(self, key, rows, timerValues):
        before = self.held()
        after, came, dues = dict(before), {}, []
        for r in rows:
            came.setdefault(r.request_id, ([], []))[r.is_answer].append(r.us)
        for id_, (asks, replies) in came.items():
            asked, first, early = parsed(before[id_]) if id_ in before else (None, None, [])
            if asked is None:
                asked, replies, early = min(asks, default=None), replies + early, []
            if asked is None:
                early = replies
            else:
                in_time = [us for us in replies if 0 <= us - asked <= self.timeout_ms * 1000]
                first = min(in_time + ([] if first is None else [first]), default=None)
            after[id_] = compact((asked, first, early))
            dues.append(self.due(asked, first, early))
        self.keep(before, after)
        self.wake(min(dues))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, before = passed_by(timerValues, expiredTimerInfo), self.held()
        after, dues = {}, []
        for id_, text in before.items():
            asked, first, early = parsed(text)
            due = self.due(asked, first, early)
            if due > now:
                after[id_] = text
                dues.append(due)
            elif asked is not None:
                yield FIRST_ANSWER(id_, asked, first)
        self.keep(before, after)
        self.wake_next(dues)


def millis(ts) -> int:
    return int(ts.timestamp() * 1000)


FIRST_ANSWERS = "request_id string, request_us bigint, response_us bigint"
FIRST_ANSWER = namedtuple("FirstAnswer", "request_id request_us response_us")
FAN_IN = "batch_id string, value string, ts timestamp, seq bigint, complete boolean, seen bigint, products string"
FAN_IN_ROWS = FAN_IN.replace("ts timestamp", "us bigint")
FAN_IN_ROW = namedtuple("FanInRow", "batch_id value us seq complete seen products")
