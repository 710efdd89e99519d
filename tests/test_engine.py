"""An index from a tree, its upkeep and its verbs, end to end."""

import pytest

from tessella.engine import Budgets, Engine, explore
from tessella.streaming import changes

FILES = {
    "shop/cart.py": "from shop.price import total_price\n\n\nclass Cart:\n    def checkout(self, items):\n        amount = total_price(items)\n        return charge_card(amount)\n\n\ndef charge_card(amount):\n    token = 'abcdefgh12345678'\n    return amount\n",
    "shop/price.py": "def total_price(items):\n    return sum(unit_price(i) for i in items)\n\n\ndef unit_price(item):\n    return item.price\n",
    "web/app.ts": "import { render } from './view';\nexport function start(name: string) {\n  return render(name);\n}\n",
    "web/view.ts": "export function render(name: string) {\n  return name;\n}\n",
    "notes.md": "# Notes\ncheckout of carts\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    made = Engine(spark, str(root), str(tmp_path_factory.mktemp("index") / "i"))
    made.build()
    made.tree = root
    return made


def test_build_resolves_calls(engine):
    stats = engine.stats().first()
    assert (stats.files, stats.symbols) == (5, 7)
    calls = {(r.in_name.split("::", 1)[-1], r.out_name) for r in engine.calls().where("confidence is null").collect()}
    assert {("Cart::checkout", "shop/price.py::total_price"), ("Cart::checkout", "shop/cart.py::charge_card"), ("total_price", "shop/price.py::unit_price"), ("start", "web/view.ts::render")} <= calls
    assert not [r for r in engine.changes().collect()]
    assert engine.counted() == engine.counted() == stats.asDict() and engine.status() == "serve" and engine.status(mutating=True) == "wait"


def test_events_keys_and_polls(engine, spark, tmp_path):
    own = Engine(spark, engine.root, str(tmp_path / "i"))
    heard, deaf = own.events.subscribe(), own.events.subscribe()
    assert own.status() == "wait" and own.ignored() == [] and own.ignored(["web"]) == ["web"]
    own.build("first")
    assert [e["stage"] for e in heard][-1] == "commit" and {e["stage"] for e in heard} > {"chunk", "symbol"} and len(deaf) == len(heard)
    assert {r.file.split("/")[0] for r in own.index.read("file_meta").collect()} == {"shop", "notes.md"}
    runs = []
    query = changes.poll(spark, runs.append, str(tmp_path / "polls"), once=True)
    query.awaitTermination()
    assert runs == ["poll-0"] and changes.progress(query)


def test_verbs(engine):
    found = engine.candidates("checkout cart").collect()
    assert "shop/cart.py" in {r.file for r in found} and all(r.content.strip() for r in found)
    assert {r.file for r in engine.candidates("lang:typescript render").collect()} <= {"web/app.ts", "web/view.ts"}
    answered = engine.retrieve("checkout cart").orderBy("place").collect()
    body = "\n".join(r.body for r in answered)
    assert "5:     def checkout(self, items):" in body and "abcdefgh12345678" not in body and "<redacted value>" in body
    assert "shop/price.py" in {r.file for r in answered}
    short = engine.retrieve("checkout cart", budget=10).collect()
    assert short and not any(r.whole for r in short) and all("\n" not in r.body for r in short)
    assert [r.path for r in engine.trace("checkout", "unit_price").collect()] == ["shop/cart.py::Cart::checkout > shop/price.py::total_price > shop/price.py::unit_price"]
    assert {r.fqn: r.depth for r in engine.impact("unit_price").collect()} == {"shop/price.py::total_price": 1, "shop/cart.py::Cart::checkout": 2}
    diff = "--- a/shop/price.py\n+++ b/shop/price.py\n@@ -5,2 +5,2 @@ def unit_price(item):\n def unit_price(item):\n-    return item.cost\n+    return item.price\n"
    assert {r.fqn for r in engine.changes_impact(diff).collect()} == {"shop/price.py::total_price", "shop/cart.py::Cart::checkout"}
    text = engine.context("charge_card").first().text
    assert "shop/cart.py:10-12" in text and "[callers: checkout" in text
    with pytest.raises(LookupError, match="no symbol"):
        engine.context("nothing_like_it")
    assert [(r.file, r.ln) for r in engine.grep("return (sum|item)", "shop/*.py").collect()] == [("shop/price.py", 2), ("shop/price.py", 6)]
    assert engine.retrieve_file("shop/price.py", "unit price").count() == 1


def test_a_reranker_orders_and_cuts(engine):
    class Second:
        def reply(self, query, entries):
            self.entries = entries
            return "[1]"

    own = Engine(engine.spark, engine.root, engine.index.root, reranker=Second())
    names = [r.file for r in own.candidates("checkout cart").orderBy("file").collect()]
    assert len(names) > 1
    assert own.retrieve("checkout cart").count() >= 1 and len(own.reranker.entries) == len(names)


class Script:
    def __init__(self, *actions):
        self.actions = list(actions)

    def act(self, query, session):
        return self.actions.pop(0) if self.actions else {"done": True}


def test_agents_keep_within_budgets(engine):
    one = explore(engine, "checkout cart", Script({"add": [0, 0, 99]}, {"grep": "unit_price"}, {"read": "web/app.ts"}, {"query": "render"}))
    assert one.ended == "done" and len(one.kept) == 1 and one.queries == 3 and {"web/app.ts", "shop/price.py"} <= {c["file"] for c in one.seen}
    assert explore(engine, "checkout cart", Script({"done": True})).kept == []
    cut = explore(engine, "checkout cart", Script(*[{"query": "x"}] * 5), budgets=Budgets(queries=2))
    assert cut.ended == "queries" and cut.kept
    assert explore(engine, "checkout cart", Script({}, {}, {}, {}), budgets=Budgets(retries=2)).ended == "format"
    assert explore(engine, "checkout cart", Script({"add": [0, 1, 2]}), budgets=Budgets(chars=1)).kept == []


def test_update_equals_a_build(engine, spark, tmp_path):
    tree = engine.tree
    (tree / "shop/price.py").write_text("def total_price(items):\n    return fixed_price(items)\n\n\ndef fixed_price(items):\n    return 7\n")
    (tree / "web/view.ts").unlink()
    (tree / "shop/new.py").write_text("def extra():\n    return total_price([])\n")
    kinds = {r.path: r.kind for r in engine.changes().collect()}
    assert kinds == {"shop/price.py": "modified", "web/view.ts": "deleted", "shop/new.py": "added"}
    n = engine.update("edit")
    assert engine.update("edit") == n and engine.update("again") == n
    fresh = Engine(spark, engine.root, str(tmp_path / "fresh"))
    fresh.build()
    for table in ("chunk", "symbol", "raw_edge", "vector", "file_meta"):
        rows = lambda e: sorted(map(str, e.index.read(table).select(sorted(e.index.read(table).columns)).collect()))  # noqa: B023, E731
        assert rows(engine) == rows(fresh), table
    compact = engine.index.compacted(str(tmp_path / "compact"), ["chunk", "symbol"], "compact")
    assert compact.read("symbol").count() == fresh.symbols().count()
    other = Engine(spark, engine.root, engine.index.root)
    other.embedder.identity = "other"
    with pytest.raises(ValueError, match="the index is of"):
        other.index.apply("x", "other", spark.createDataFrame([("a", False)], "file string, deleted boolean"), {})
