import random

from archspark.operators.views import ANNOTATION
from archspark.streaming import edits

COLUMNS = [c.split()[0] for c in ANNOTATION.split(", ")]


def event(action, id_, seq, kind="file", own="c", target="f", text="x"):
    return (id_, own, kind, target, "", text, None, action, seq)


def plain(events):
    """One event after the other, in the order of their places."""
    held = {}
    for id_, own, kind, target, name, text, at, action, _ in sorted(events, key=lambda e: e[-1]):
        text = (text or "").strip()
        key = (kind, own if kind == "component" else target or own)
        if action in (None, "add") and text:
            held[key] = (id_, own, kind, target or own, name, text, at)
        elif action == "update" and text and id_ is not None:
            held = {k: (*v[:5], text, v[6]) if v[0] == id_ else v for k, v in held.items()}
        elif action == "delete" and id_ is not None:
            held = {k: v for k, v in held.items() if v[0] != id_}
        elif action == "clear":
            held = {}
    return sorted(map(str, held.values()))


class Stream:
    def __init__(self, spark, folder):
        self.spark, self.source, self.out, self.checkpoint = spark, str(folder / "in"), str(folder / "out"), str(folder / "cp")

    def take(self, events):
        self.spark.createDataFrame(events, edits.EVENT).coalesce(1).write.mode("append").parquet(self.source)
        edits.keep(self.spark.readStream.schema(edits.EVENT).parquet(self.source), self.out, self.checkpoint).awaitTermination()

    def state(self, n):
        return sorted(str(tuple(r[c] for c in COLUMNS)) for r in edits.state(self.spark, self.out, n).collect())


def some_events(rng, n):
    out = []
    for seq in range(n):
        action = rng.choice([None, "add", "add", "add", "update", "update", "delete", "clear" if rng.random() < 0.1 else "add"])
        id_ = f"i{rng.randrange(max(seq, 1))}" if action in ("update", "delete") else f"i{seq}"
        out.append(event(action, id_ if rng.random() > 0.05 else None, seq, rng.choice(["file", "component", "symbol"]), f"c{rng.randrange(3)}", rng.choice(["f", "g", None]), rng.choice([" a ", "b", "", None, f"t{seq}"])))
    return out


def test_any_order_of_events_gives_what_their_places_say(spark, tmp_path):
    for seed in range(3):
        rng = random.Random(seed)
        events = some_events(rng, 60)
        arrived = rng.sample(events, len(events))
        at = Stream(spark, tmp_path / str(seed))
        for n in range(3):
            at.take(arrived[20 * n : 20 * n + 20] + arrived[: 5 * n])  # some come again
        assert at.state(2) == plain(events)
        assert at.state(1) == plain(arrived[:40])


def test_late_edits_and_clearings(spark, tmp_path):
    at = Stream(spark, tmp_path)
    at.take([event("update", "a", 5, text="new"), event("delete", "b", 6), event("clear", None, 2)])
    assert at.state(0) == []
    at.take([event("add", "a", 3), event("add", "b", 4, target="g"), event("add", "z", 1, target="h"), event("add", "b", 7, target="k")])
    assert at.state(1) == sorted([str(("a", "c", "file", "f", "", "new", None)), str(("b", "c", "file", "k", "", "x", None))])
    at.take([event("clear", None, 9), event("delete", None, 10), event("update", "a", 11, text=" ")])
    assert at.state(2) == []


def test_a_batch_without_any_event(spark, tmp_path):
    at = Stream(spark, tmp_path)
    at.take([event("add", "a", 1, text=" ")])
    assert at.state(0) == [] and at.state(-1) == []
