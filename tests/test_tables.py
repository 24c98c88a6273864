import pytest

from tessera import errors as E
from tessera.engine import Engine


def rows(e, sql):
    return [tuple(r) for r in e.execute(sql).collect()]


@pytest.fixture
def bank(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE accounts (id int, balance int)")
    for i in range(1, 4):
        e.execute(f"INSERT INTO accounts VALUES ({i}, 100)")
    return e


def test_status_rows(spark):
    e = Engine(spark)
    assert e.execute("CREATE TABLE IF NOT EXISTS t (a int)").columns == ["status"]
    assert e.execute("CREATE TABLE IF NOT EXISTS t (a int)").columns == ["status"]
    assert rows(e, "INSERT INTO t VALUES (5)") == [(1,)] and rows(e, "INSERT INTO t VALUES (6)") == [(2,)]
    assert rows(e, "SELECT * FROM t ORDER BY a") == [(1, 5), (2, 6)]
    assert rows(e, "DROP TABLE IF EXISTS nope")[0][0].startswith("Table")


def test_update_delete_counts(bank):
    assert rows(bank, "UPDATE accounts SET balance = 5 WHERE id > 1") == [(2,)]
    assert rows(bank, "UPDATE accounts SET balance = 6 WHERE id = 3") == [(1,)]
    assert rows(bank, "DELETE FROM accounts WHERE balance = 5") == [(1,)]
    assert rows(bank, "SELECT id, balance FROM accounts ORDER BY id") == [(1, 100), (3, 6)]
    assert rows(bank, "DELETE FROM accounts") == [(2,)] and rows(bank, "SELECT COUNT(*) FROM accounts") == [(0,)]


def test_schema_changes(bank):
    bank.execute("CREATE INDEX by_balance ON accounts (balance)")
    bank.execute("ALTER TABLE accounts ADD COLUMN note text")
    bank.execute("UPDATE accounts SET note = 'x' WHERE id = 1")
    bank.execute("ALTER TABLE accounts RENAME COLUMN balance TO amount")
    assert rows(bank, "SELECT id, amount, note FROM accounts ORDER BY id") == [(1, 100, "x"), (2, 100, None), (3, 100, None)]
    assert [r[0] for r in bank.index_range("by_balance", 50, 100).collect()] == [2, 3, 1] or bank.index_query("by_balance", 100).count() == 3
    assert bank.indexes_of("accounts") == ["by_balance"] and bank.index_for("accounts", "amount") == "by_balance" and bank.index_for("accounts", "id") is None
    bank.execute("ALTER TABLE accounts DROP COLUMN amount")
    assert bank.indexes == {} and bank.execute("SELECT * FROM accounts").columns == ["id", "note"]


def test_transactions(bank):
    other = bank.session()
    bank.execute("BEGIN")
    bank.execute("UPDATE accounts SET balance = 1 WHERE id = 1")
    bank.execute("DELETE FROM accounts WHERE id = 2")
    assert rows(bank, "SELECT id, balance FROM accounts ORDER BY id") == [(1, 1), (3, 100)]
    assert [tuple(r) for r in other.execute("SELECT COUNT(*) FROM accounts WHERE balance = 100").collect()] == [(3,)]
    bank.execute("ROLLBACK")
    assert rows(bank, "SELECT COUNT(*) FROM accounts WHERE balance = 100") == [(3,)]
    bank.execute("UPDATE accounts SET balance = 2 WHERE id = 1")  # no residue of the rollback


def test_snapshot_and_first_writer_wins(bank):
    a, b = bank.session(), bank.session()
    a.execute("BEGIN")
    b.execute("BEGIN")
    b.execute("UPDATE accounts SET balance = 7 WHERE id = 1")
    with pytest.raises(E.SerializationFailure):
        a.execute("UPDATE accounts SET balance = 8 WHERE id = 1")
    b.execute("COMMIT")
    bank.execute("INSERT INTO accounts VALUES (4, 100)")
    assert [tuple(r) for r in a.execute("SELECT COUNT(*), SUM(balance) FROM accounts").collect()] == [(3, 300.0)]
    with pytest.raises(E.SerializationFailure):
        a.execute("DELETE FROM accounts WHERE id = 1")
    a.execute("COMMIT")
    assert rows(bank, "SELECT COUNT(*), SUM(balance) FROM accounts") == [(4, 307.0)]


def test_nested_transactions(bank):
    bank.execute("BEGIN")
    bank.execute("DELETE FROM accounts WHERE id = 1")
    bank.execute("BEGIN")
    bank.execute("DELETE FROM accounts WHERE id = 2")
    bank.execute("ROLLBACK")
    bank.execute("COMMIT")
    assert rows(bank, "SELECT id FROM accounts ORDER BY id") == [(2,), (3,)]


def test_vacuum(bank):
    for i in range(3):
        bank.execute(f"UPDATE accounts SET balance = {i}")
    assert tuple(bank.table_stats("accounts").first()) == (3, 12, 4)
    assert rows(bank, "VACUUM accounts") == [("accounts", 9, 3, 3, 1)]
    assert rows(bank, "SELECT id, balance FROM accounts ORDER BY id") == [(1, 2), (2, 2), (3, 2)]


def test_auto_vacuum(bank):
    bank.vacuum_config.chain_length = 3
    for i in range(5):
        bank.execute(f"UPDATE accounts SET balance = {i}")
    assert tuple(bank.table_stats("accounts").first())[2] < 4


def test_recovery(spark, tmp_path):
    root = str(tmp_path / "db")
    e = Engine(spark, root)
    e.execute("CREATE TABLE t (id int, v embedding(2))")
    e.execute("INSERT INTO t VALUES (1, [0.5, 1])")
    e.execute("INSERT INTO t VALUES (2, NULL)")
    e.execute("BEGIN")
    e.execute("INSERT INTO t VALUES (3, NULL)")  # never committed
    again = Engine(spark, root)
    assert again.recovered == 2 and rows(again, "SELECT id, v FROM t ORDER BY id") == [(1, [0.5, 1.0]), (2, None)]
    last = sorted((tmp_path / "db" / "_log").glob("*.json"))[-1]
    last.write_text(last.read_text()[:-9])  # a torn commit is none
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    torn = Engine(spark, root)
    assert rows(torn, "SELECT id FROM t") == [(1,)]
    assert rows(torn, "INSERT INTO t VALUES (9, NULL)") == [(2,)]


def test_checkpoint_of_the_log(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE t (id int)")
    e.execute("INSERT INTO t VALUES (1)")
    e.checkpoint()
    e.execute("INSERT INTO t VALUES (2)")
    again = Engine(spark, str(tmp_path / "db"))
    assert again.recovered == 1 and rows(again, "SELECT COUNT(*) FROM t") == [(2,)]


def test_segments_save_and_load(spark, tmp_path):
    root = str(tmp_path / "db")
    e = Engine(spark, root)
    e.execute("CREATE TABLE big (k int, w text)")
    assert e.insert_df("big", spark.range(3000).selectExpr("id as k", "'a' as w")) == 3000
    e.execute("UPDATE big SET w = 'b' WHERE k < 2000")
    e.execute("DELETE FROM big WHERE k >= 2500")
    again = Engine(spark, root)
    assert rows(again, "SELECT w, COUNT(*) FROM big GROUP BY w ORDER BY w") == [("a", 500), ("b", 2000)]
    again.execute("VACUUM")
    assert len(list((tmp_path / "db" / "big").glob("*"))) == 1
    again.save(str(tmp_path / "copy"))
    assert rows(Engine.load(spark, str(tmp_path / "copy")), "SELECT COUNT(*) FROM big") == [(2500,)]
    assert Engine.load(spark, str(tmp_path / "none")).tables == {}


def test_embeddings(spark):
    e = Engine(spark, max_embeddings_per_row=2)
    with pytest.raises(E.TooManyEmbeddings):
        e.execute("CREATE TABLE x (a embedding(2), b embedding(2), c embedding(2))")
    e.execute("CREATE TABLE x (id int, a embedding(3))")
    with pytest.raises(E.ValidationFailed):
        e.execute("INSERT INTO x VALUES (1, [1, 2])")
    e.execute("INSERT INTO x VALUES (1, [1, 0, 0])")
    assert e.rebuild_vectors() == 1
    assert [r.id for r in e.vectors("x", "a").search([1.0, 0.0, 0.0], 1).collect()] == [1]


def test_similarity_filters_first(spark):
    e = Engine(spark, embedder=lambda text, dim: [1.0, 0.0])
    e.execute("CREATE TABLE v (id int, tag text, a embedding(2))")
    for i, (tag, y) in enumerate([("x", 0), ("y", 1), ("x", 2), ("y", 3)], 1):
        e.execute(f"INSERT INTO v VALUES ({i}, '{tag}', [1, {y}])")
    assert rows(e, "SELECT id FROM v WHERE tag = 'y' ORDER BY SIMILARITY TO 'q' LIMIT 2") == [(2,), (4,)]
    e.options.similarity_filter = "post"
    assert rows(e, "SELECT id FROM v WHERE tag = 'y' ORDER BY SIMILARITY TO 'q' LIMIT 2") == [(2,)]
    e.options.similar_threshold = 0.01
    assert rows(e, "SELECT id FROM v WHERE a SIMILAR TO 'q'") == [(1,)]


def test_two_engines_on_one_root(spark, tmp_path):
    """The loser of a race takes the winner's commits over; what doesn't fit is a SerializationFailure."""
    root = str(tmp_path / "db")
    a = Engine(spark, root)
    a.execute("CREATE TABLE t (id int, v int)")
    for i in range(3):
        a.execute(f"INSERT INTO t VALUES ({i}, 0)")
    b = Engine(spark, root)
    a.execute("INSERT INTO t VALUES (10, 1)")
    b.execute("INSERT INTO t VALUES (11, 2)")  # same version and row id at first, both moved on
    a.execute("UPDATE t SET v = 5 WHERE id = 0")
    assert rows(a, "SELECT id, v FROM t ORDER BY id") == [(0, 5), (1, 0), (2, 0), (10, 1), (11, 2)]
    with pytest.raises(E.SerializationFailure):
        b.execute("UPDATE t SET v = 6 WHERE id = 0")  # changed since b read the log
    b.refresh()
    b.execute("UPDATE t SET v = 6 WHERE id = 0")
    b.execute("UPDATE t SET v = 7 WHERE id = 1")
    a.execute("UPDATE t SET v = 8 WHERE id = 2")  # another row: it fits
    want = [(0, 6), (1, 7), (2, 8), (10, 1), (11, 2)]
    assert rows(a, "SELECT id, v FROM t ORDER BY id") == rows(Engine(spark, root), "SELECT id, v FROM t ORDER BY id") == want
    a.execute("VACUUM t")
    a.execute("INSERT INTO t VALUES (12, 3)")
    assert b.refresh() > 0 and rows(b, "SELECT id, v FROM t ORDER BY id") == [*want, (12, 3)]
    b.execute("ALTER TABLE t ADD COLUMN w int")
    with pytest.raises(E.SerializationFailure):
        a.execute("ALTER TABLE t ADD COLUMN x int")


def test_few_updates_do_not_rewrite_a_large_table(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (id int)")
    e.insert_df("t", spark.range(2000).toDF("id"))
    for i in range(13):
        e.execute(f"UPDATE t SET id = {i} WHERE id = {i}")
    assert len(e.tables["t"].parts) == 14
    e.execute("UPDATE t SET id = 0 WHERE id < 400")  # a fifth of the rows
    assert len(e.tables["t"].parts) == 1 and e.execute("SELECT COUNT(*) FROM t").first()[0] == 2000


def test_many_inline_rows_become_a_part(spark, monkeypatch):
    from tessera import engine

    monkeypatch.setattr(engine, "INLINE_TOTAL", 30)
    monkeypatch.setattr(engine, "INLINE_ROWS", 20)
    e = Engine(spark)
    e.execute("CREATE TABLE t (id int)")
    for k in range(4):
        e.insert_df("t", spark.range(10 * k, 10 * k + 10).toDF("id"))
    assert sum(p.count for p in e.tables["t"].parts if p.rows is not None) <= 30
    assert sorted(r[0] for r in rows(e, "SELECT id FROM t")) == list(range(40))


def test_a_source_runs_once(spark, tmp_path):
    from pyspark.sql import functions as F

    for root in (None, str(tmp_path / "db")):
        e, seen = Engine(spark, root), spark.sparkContext.accumulator(0)
        e.execute("CREATE TABLE t (id int)")
        count = F.udf(lambda x: (seen.add(1), x)[1], "bigint").asNondeterministic()
        assert e.insert_df("t", spark.range(1500).select(count("id").alias("id"))) == 1500 and seen.value == 1500


def test_shared_folder_is_needed_on_a_cluster():
    from tessera.functions.lineage import shared_folder

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Spark:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_folder(Spark())
