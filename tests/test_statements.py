import pytest

from quern.statements import Shell, split_list, split_statements
from quern.storage import new_dir
from quern.tables.database import ConstraintError, Database


def test_splitting():
    assert split_list("a, f(b, c), 'x,y', (1, 2)") == ["a", "f(b, c)", "'x,y'", "(1, 2)"]
    assert split_statements("a 'x;y'; -- c;\n b /* ; */;") == ["a 'x;y'", "b"]


def test_script(spark, tmp_path):
    shell = Shell(Database(spark, new_dir(spark, "shell")))
    shell.script("""
        CREATE TABLE customers (id INT NOT NULL PRIMARY KEY, name VARCHAR(30) NOT NULL, city TEXT DEFAULT 'none');
        CREATE TABLE orders (id INT PRIMARY KEY, customer_id INT REFERENCES customers(id), price DOUBLE CHECK (price >= 0), UNIQUE (customer_id, price));
        INSERT INTO customers (id, name) VALUES (1, 'Ann; A.'), (2, 'Bo'); -- two
        INSERT INTO orders VALUES (1, 1, 2.5), (2, 1, 4.0), (3, NULL, 1.0);
    """)
    assert shell.execute("SELECT name, sum(price) AS s FROM customers JOIN orders ON customer_id = customers.id GROUP BY name").collect() == [("Ann; A.", 6.5)]
    assert shell.execute("UPDATE orders SET price = price * 2, customer_id = 2 WHERE id = 3") == 1
    assert shell.execute("DELETE FROM orders WHERE price > 4.5") == 0
    for bad in ("INSERT INTO orders VALUES (9, 77, 1.0)", "INSERT INTO orders VALUES (9, 1, -1.0)", "INSERT INTO customers VALUES (1, 'x', 'y')", "INSERT INTO customers VALUES (5, NULL, 'y')"):
        with pytest.raises(ConstraintError):
            shell.execute(bad)
    shell.script("BEGIN; TRUNCATE orders; ROLLBACK")
    assert shell.execute("SELECT count(*) AS n FROM orders").first().n == 3
    shell.script("PREPARE q AS SELECT name FROM customers WHERE id = $1")
    assert shell.execute("EXECUTE q(2)").first().name == "Bo"
    shell.execute("DEALLOCATE q")
    shell.script("ALTER TABLE customers ADD COLUMN age INT DEFAULT 3; ALTER TABLE customers RENAME COLUMN city TO town; CREATE UNIQUE INDEX u ON customers (name); ALTER TABLE orders RENAME TO sales")
    assert [r.name for r in shell.execute("SHOW TABLES").collect()] == ["customers", "sales"] and shell.execute("DESCRIBE customers").count() == 4
    assert "Scan parquet" in shell.execute("EXPLAIN SELECT * FROM customers").first().plan and shell.execute("ANALYZE TABLE customers").count() == 4
    path = tmp_path / "c.csv"
    path.write_text("id,name,town,age\n7,Cy,x,1\nbad,D,y,2\n8,Ed,,\n")
    assert shell.execute(f"COPY INTO customers FROM '{path}'") == (2, 1)
    assert shell.execute(f"CREATE TABLE copied AS COPY FROM '{path}'") == (3, 0)
    shell.execute("DROP TABLE IF EXISTS copied, missing")
    with pytest.raises(ValueError):
        shell.execute("SHOW nothing")


def test_changes_with_subqueries_arguments_and_quotes(spark):
    shell = Shell(Database(spark, new_dir(spark, "shell")))
    shell.script("CREATE TABLE a (id INT PRIMARY KEY, v INT, s TEXT); CREATE TABLE b (k INT); INSERT INTO a VALUES (1, 10, 'x'), (2, 20, 'y'), (3, NULL, 'z'); INSERT INTO b VALUES (2), (3)")
    assert shell.execute("UPDATE a SET v = (SELECT max(k) FROM b) + id, s = 'a where b' WHERE id IN (SELECT k FROM b)") == 2
    assert sorted(tuple(r) for r in shell.execute("SELECT * FROM a").collect()) == [(1, 10, "x"), (2, 5, "a where b"), (3, 6, "a where b")]
    assert shell.execute("UPDATE a SET v = ? WHERE id = ?", 7, 1) == 1 and shell.execute("UPDATE a SET v = $2 / 2 WHERE id = $1", 2, 7) == 1
    assert sorted(r.v for r in shell.execute("SELECT v FROM main.a").collect()) == [3, 6, 7]
    assert shell.execute("DELETE FROM a WHERE EXISTS (SELECT 1 FROM b WHERE k = a.id) AND v > :least", least=5) == 1
    assert shell.execute("SELECT count(*) AS n FROM a").first().n == 2


def test_definitions_stay_and_failures_leave_nothing(spark):
    path = new_dir(spark, "kept")
    shell = Shell(Database(spark, path))
    shell.script("CREATE TABLE a (id INT PRIMARY KEY, v DOUBLE DEFAULT 1.5); CREATE SCHEMA other; INSERT INTO a (id) VALUES (1)")
    with pytest.raises(ValueError):
        shell.execute("CREATE TABLE bad (id NOTYPE)")
    assert shell.execute("SELECT 1 AS one").first().one == 1
    again = Shell(Database(spark, path))
    assert again.execute("SELECT v FROM a").first().v == 1.5 and again.db.schemas == {"main", "other"}
    with pytest.raises(ConstraintError):
        again.execute("INSERT INTO a (id) VALUES (1)")
    again.script("BEGIN; CREATE TABLE c (id INT); DELETE FROM a; ROLLBACK")
    assert [r.name for r in again.execute("SHOW TABLES").collect()] == ["a"] and again.execute("SELECT count(*) AS n FROM a").first().n == 1
