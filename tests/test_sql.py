import pytest

from tessera import errors as E
from tessera.engine import Engine


@pytest.fixture
def db(spark):
    """Five peaks, one of unknown height and one that nobody climbs, and six climbs."""
    e = Engine(spark)
    e.execute("CREATE TABLE peaks (id int, title text, height int)")
    e.execute("CREATE TABLE climbs (id int, peak int, hours float)")
    for row in ("11, 'Arber', 1456", "12, 'Brocken', 1141", "13, 'Cervino', 4478", "14, 'Dent', NULL", "15, 'Eiger', 3967"):
        e.execute(f"INSERT INTO peaks VALUES ({row})")
    for row in ("1, 11, 3.5", "2, 13, 9.0", "3, 13, 11.0", "4, 15, 8.5", "5, 15, 10.5", "6, 14, 2.0"):
        e.execute(f"INSERT INTO climbs VALUES ({row})")
    return e


def rows(e, sql):
    return [tuple(r) for r in e.execute(sql).collect()]


def test_joins(db):
    both = db.execute("SELECT * FROM climbs c JOIN peaks p ON p.id = c.peak")
    assert both.columns == ["c.id", "c.peak", "c.hours", "p.id", "p.title", "p.height"] and both.count() == 6
    every = "SELECT p.title, c.hours FROM peaks p LEFT JOIN climbs c ON c.peak = p.id ORDER BY p.title, c.hours"
    assert rows(db, every) == [("Arber", 3.5), ("Brocken", None), ("Cervino", 9.0), ("Cervino", 11.0), ("Dent", 2.0), ("Eiger", 8.5), ("Eiger", 10.5)]
    assert len(rows(db, "SELECT p.id FROM climbs c RIGHT OUTER JOIN peaks p ON c.peak = p.id")) == 7
    assert len(rows(db, "SELECT climbs.id FROM peaks INNER JOIN climbs ON peaks.id = climbs.peak")) == 6


def test_null_keys_never_match(db):
    db.execute("INSERT INTO climbs VALUES (7, NULL, 1.0)")
    db.execute("INSERT INTO peaks VALUES (NULL, 'Nameless', 1)")
    assert len(rows(db, "SELECT c.id FROM peaks p JOIN climbs c ON c.peak = p.id")) == 6
    assert rows(db, "SELECT title FROM peaks WHERE id NOT IN (SELECT peak FROM climbs) ORDER BY title") == [("Brocken",), ("Nameless",)]


def test_grouping(db):
    often = db.execute("SELECT SUM(hours), peak, COUNT(*) FROM climbs GROUP BY peak HAVING COUNT(*) > 1")
    assert often.columns == ["peak", "SUM(hours)", "COUNT(*)"]
    assert sorted(tuple(r) for r in often.collect()) == [(13, 20.0, 2), (15, 19.0, 2)]
    assert rows(db, "SELECT MIN(hours), COUNT(*), AVG(hours), SUM(hours) FROM climbs WHERE hours > 24.0") == [(None, 0, None, 0.0)]
    assert rows(db, "SELECT COUNT(height), COUNT(*) FROM peaks") == [(4, 5)]
    assert rows(db, "SELECT MAX(height) FROM peaks LIMIT 0") == []


def test_subqueries(db):
    assert rows(db, "SELECT title FROM peaks WHERE id IN (SELECT peak FROM climbs WHERE hours < 9.0) ORDER BY title") == [("Arber",), ("Dent",), ("Eiger",)]
    assert rows(db, "SELECT title FROM peaks WHERE NOT (id IN (SELECT peak FROM climbs))") == [("Brocken",)]
    assert rows(db, "SELECT title FROM peaks WHERE height > (SELECT AVG(height) FROM peaks) ORDER BY height") == [("Eiger",), ("Cervino",)]
    assert rows(db, "SELECT title FROM peaks WHERE height > (SELECT MIN(height) FROM peaks WHERE id > 99)") == []
    assert len(rows(db, "SELECT title FROM peaks WHERE EXISTS (SELECT 1 FROM climbs WHERE hours > 10.9)")) == 5
    slow = rows(db, "SELECT peak, AVG(hours) FROM climbs GROUP BY peak HAVING AVG(hours) > (SELECT AVG(hours) FROM climbs)")
    assert sorted(slow) == [(13, 10.0), (15, 9.5)]
    with pytest.raises(E.InvalidSubquery):
        db.execute("SELECT title FROM peaks WHERE id IN (SELECT peak, hours FROM climbs)")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        db.execute("SELECT title FROM peaks WHERE id = (SELECT peak FROM climbs)").collect()


def test_scalar_subquery_of_several_rows(db):
    for statement in (
        "SELECT title FROM peaks WHERE id = (SELECT peak FROM climbs)",
        "SELECT title FROM peaks WHERE id IN (SELECT peak FROM climbs WHERE hours > (SELECT height FROM peaks))",
        "SELECT peak FROM climbs GROUP BY peak HAVING COUNT(*) > (SELECT COUNT(*) FROM climbs GROUP BY peak)",
        "DELETE FROM peaks WHERE id = (SELECT peak FROM climbs)",
        "UPDATE peaks SET title = 'x' WHERE id = (SELECT peak FROM climbs LIMIT 2)",
    ):
        with pytest.raises(E.SubqueryReturnedMultipleRows):
            db.execute(statement)
    assert rows(db, "SELECT COUNT(*) FROM peaks") == [(5,)]
    assert rows(db, "SELECT title FROM peaks WHERE id = (SELECT peak FROM climbs WHERE hours < 0.0)") == []
    assert rows(db, "SELECT title FROM peaks WHERE id = (SELECT peak FROM climbs ORDER BY hours DESC, id LIMIT 1)") == rows(
        db, "SELECT p.title FROM peaks p JOIN climbs c ON p.id = c.peak ORDER BY c.hours DESC, c.id LIMIT 1")
    assert rows(db, "SELECT title FROM peaks WHERE id = (SELECT id FROM peaks WHERE height = 1141)") == [("Brocken",)]


def test_order_and_paging(db):
    assert [t for t, in rows(db, "SELECT title FROM peaks ORDER BY height")] == ["Dent", "Brocken", "Arber", "Eiger", "Cervino"]
    assert rows(db, "SELECT title FROM peaks ORDER BY height DESC, title LIMIT 2 OFFSET 1") == [("Eiger",), ("Arber",)]
    assert rows(db, "SELECT title FROM peaks ORDER BY title OFFSET 5") == []
    assert sorted(rows(db, "SELECT id FROM climbs ORDER BY VIBES")) == [(k,) for k in range(1, 7)]


def test_like(db):
    assert rows(db, "SELECT title FROM peaks WHERE title LIKE '_i%'") == [("Eiger",)]
    db.execute(r"INSERT INTO peaks VALUES (16, 'up\down%', 1)")
    assert rows(db, r"SELECT id FROM peaks WHERE title LIKE 'up\down%'") == [(16,)]
    assert rows(db, "SELECT id FROM peaks WHERE title LIKE ''") == []
    db.execute("INSERT INTO peaks VALUES (17, 'Devil''s', 1)")
    assert rows(db, "SELECT id FROM peaks WHERE title = \"Devil's\"") == [(17,)]


def test_two_valued_nulls(spark, db):
    other, negated = ("SELECT id FROM peaks WHERE height != 1456", "SELECT id FROM peaks WHERE NOT height = 1456")
    assert sorted(rows(db, other)) == sorted(rows(db, negated)) == [(12,), (13,), (15,)]
    db.options.null_semantics = "two_valued"
    assert sorted(rows(db, other)) == sorted(rows(db, negated)) == [(12,), (13,), (14,), (15,)]
    assert rows(db, "SELECT id FROM peaks WHERE height = NULL") == [(14,)]


def test_truthiness(db):
    assert sorted(rows(db, "SELECT id FROM peaks WHERE height")) == [(11,), (12,), (13,), (15,)]
    assert len(rows(db, "SELECT id FROM peaks WHERE title")) == 5


@pytest.mark.parametrize("sql", [
    "SELECT a FROM t WHERE a == 1", "SELECT a FROM t WHERE a NOT LIKE 'x'", "SELECT * FROM a FULL JOIN b ON a.x = b.x", "SELECT * FROM a CROSS JOIN b",
    "SELECT p * 2 FROM t", "INSERT INTO t VALUES (1), (2)", "SELECT SUM(*) FROM t", "CREATE TABLE t (a Int)", "INSERT INTO t VALUES ([])", "SELECT a FROM t UNION SELECT b FROM u",
    "SELECT a.b.c FROM t", "CREATE TABLE t (e embedding)", "", "SELECT", "DELETE FROM t WHERE a = 1 extra",
])
def test_what_is_not_understood_raises(spark, sql):
    with pytest.raises(E.InvalidSyntax):
        Engine(spark).execute(sql)


@pytest.mark.parametrize("sql, error", [
    ("SELECT titel FROM peaks", E.ColumnNotFound), ("SELECT id FROM peak", E.TableNotFound), ("SELECT id FROM climbs c JOIN peaks p ON p.id = c.peak", E.AmbiguousColumn),
    ("SELECT q.id FROM peaks p", E.ColumnNotFound), ("SELECT title, COUNT(*) FROM peaks", E.MixedAggregateAndRegular), ("SELECT title, COUNT(*) FROM peaks GROUP BY height", E.ColumnNotInGroupBy),
    ("SELECT * FROM peaks GROUP BY title", E.CannotUseStarWithGroupBy), ("SELECT title FROM peaks HAVING height > 1", E.HavingWithoutGroupBy), ("SELECT title FROM peaks WHERE MAX(height) > 1", E.AggregateInWhere),
    ("SELECT AVG(title) FROM peaks", E.TypeMismatch), ("SELECT id FROM peaks WHERE title = 3", E.TypeMismatch), ("SELECT id FROM peaks WHERE title SIMILAR TO 'x'", E.UnsupportedFeature),
    ("SELECT id FROM peaks ORDER BY SIMILARITY TO 'x'", E.InvalidSyntax), ("SELECT p.id FROM peaks p JOIN climbs c ON p.id = c.peak ORDER BY SIMILARITY TO 'x'", E.UnsupportedFeature),
    ("CREATE TABLE climbs (a int)", E.TableAlreadyExists), ("DROP TABLE valleys", E.TableNotFound), ("ALTER TABLE peaks ADD COLUMN height int", E.InvalidSyntax), ("ALTER TABLE peaks DROP COLUMN snow", E.ColumnNotFound),
    ("DROP INDEX nothing", E.IndexNotFound), ("INSERT INTO peaks VALUES (1, 'x')", E.ValidationFailed), ("INSERT INTO peaks VALUES ('x', 'x', 1)", E.TypeMismatch), ("UPDATE peaks SET heigth = 1", E.ColumnNotFound),
    ("COMMIT", E.NoActiveTransaction), ("ROLLBACK", E.NoActiveTransaction),
])
def test_named_errors(db, sql, error):
    with pytest.raises(error):
        db.execute(sql)


def test_hint(db):
    with pytest.raises(E.ColumnNotFound, match="did you mean 'height'"):
        db.execute("SELECT heihgt FROM peaks")


def test_validation_modes(spark, db):
    db.validation = "warnings"
    with pytest.warns(UserWarning, match="ColumnNotFound"):
        db.execute("INSERT INTO peaks (id, snow) VALUES (20, 1)")
    db.validation = "disabled"
    db.execute("INSERT INTO peaks (id, snow) VALUES (21, 1)")
    assert rows(db, "SELECT COUNT(*) FROM peaks") == [(7,)]


def test_pushdown_and_pruning(spark):
    e = Engine(spark).register_parquet("/root/testdata/sf0.001", "customer", "orders")
    plan = e.execute("SELECT c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000.0")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
