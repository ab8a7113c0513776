"""Tables, COPY, queries, results and errors through the requests, and once over HTTP."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from quernstone.catalogue import col, lit, of, op
from quernstone.types import Type


def table(*columns, name="t"):
    return {"name": name, "columns": [{"name": n, "type": t} for n, t in columns]}


def copy(path, name="t", **more):
    return {"queryDefinition": {"sourceFilepath": str(path), "destinationTableName": name} | more}


def select(*columns, **more):
    return {"queryDefinition": {"columnClauses": list(columns)} | more}


def file(tmp_path, text):
    path = tmp_path / "data.csv"
    path.write_bytes(text.encode())
    return path


def rows(api, *columns, **more):
    status, query_id = api.post_query(select(*columns, **more))
    assert status == 200, query_id
    status, found = api.get_result(query_id)
    assert status == 200
    return found[0]["columns"] if found else []


def test_create_describe_list_drop(api):
    status, table_id = api.put_table(table(("id", "INT64"), ("note", "VARCHAR")))
    assert status == 200 and table_id.isdigit()
    assert api.put_table(table(("id", "INT64")))[0] == 400
    assert api.get_table(table_id) == (200, table(("id", "INT64"), ("note", "VARCHAR")))
    assert api.get_tables() == (200, [{"tableId": table_id, "name": "t"}])
    assert api.get_table("12")[0] == api.get_table("12x")[0] == api.delete_table("x")[0] == 404
    assert api.delete_table(table_id) == (200, "")
    assert api.delete_table(table_id)[0] == 404 and api.get_tables() == (200, [])


@pytest.mark.parametrize(
    "body, problems",
    [
        (table(("x", "BOOL")), 1), (table(("x", "DOUBLE"), ("x", "INT64")), 2), ({"name": "t"}, 1), ({"columns": []}, 1),
        (table(), 1), (table(("", "INT64"), name=""), 2), ({"name": "t", "columns": [{"name": "a"}]}, 1), ([], 1), ({}, 1),
    ],
)
def test_bad_tables(api, body, problems):
    status, reply = api.put_table(body)
    assert status == 400 and len(reply["problems"]) == problems and api.get_tables()[1] == []


def test_older_create_form(api):
    status, table_id = api.put_table({"old": {"columns": {"a": "INT64", "b": "VARCHAR"}}})
    assert status == 200 and api.get_table(table_id)[1] == table(("a", "INT64"), ("b", "VARCHAR"), name="old")


@pytest.mark.parametrize(
    "text, more, expected",
    [
        ("101\n202\n", {}, [[101, 202]]),
        ("id\n303\n404\n", {"doesCsvContainHeader": True}, [[303, 404]]),
        ("-5\n+6\n", {}, [[-5, 6]]),
        ("", {}, []),
        ("id\n", {"doesCsvContainHeader": True}, []),
    ],
)
def test_copy_integers(api, tmp_path, text, more, expected):
    api.put_table(table(("id", "INT64")))
    assert api.post_query(copy(file(tmp_path, text), **more))[0] == 200
    assert [sorted(c, reverse=expected[0][0] > expected[0][-1]) for c in rows(api, of("t", "id"))] == expected


def test_copy_destination_columns_separator_quotes_and_append(api, tmp_path):
    api.put_table(table(("id", "INT64"), ("note", "VARCHAR")))
    header = copy(file(tmp_path, "note,id\nx,11\n,22\n"), doesCsvContainHeader=True, destinationColumns=["note", "id"])
    assert api.post_query(header)[0] == 200
    assert api.post_query(copy(file(tmp_path, '"a;b";33\n'), destinationColumns=["note", "id"]))[0] == 200
    quoted = '44,"line\nof ""two"", mało"\n55,""\n'
    assert api.post_query(copy(file(tmp_path, quoted)))[0] == 200
    got = rows(api, of("t", "id"), col("note"), orderByClause=[{"columnIndex": 0}])
    assert got == [[11, 22, 33, 44, 55], ["x", "", "a;b", 'line\nof "two", mało', ""]]


@pytest.mark.parametrize(
    "columns, text, more",
    [
        ([("id", "INT64")], "not-a-number\n", {}), ([("id", "INT64")], "1.5\n", {}), ([("id", "INT64")], "9223372036854775808\n", {}),
        ([("id", "INT64"), ("s", "VARCHAR")], ",x\n", {}), ([("id", "INT64")], " 1 \n", {}),
        ([("a", "INT64"), ("b", "INT64"), ("c", "INT64")], "a,b\n1,2\n", {"doesCsvContainHeader": True}),
        ([("a", "INT64"), ("b", "INT64")], "1,2\n3\n", {}), ([("a", "INT64"), ("b", "INT64")], "1,2\n3,4,5\n", {}),
        ([("a", "INT64"), ("b", "INT64")], "1,2\n", {"destinationColumns": ["a"]}),
        ([("a", "INT64")], "1\n", {"destinationColumns": ["z"]}),
        ([("a", "INT64")], "b\n1\n", {"destinationColumns": ["a"], "doesCsvContainHeader": True}),
        ([("a", "INT64")], "1\n", {"doesCsvContainHeader": "yes"}),
    ],
)
def test_copy_failures_leave_nothing(api, engine, tmp_path, columns, text, more):
    api.put_table(table(*columns))
    status, reply = api.post_query(copy(file(tmp_path, text), **more))
    assert status == 400 and reply["problems"][0]["error"]
    failed = api.get_queries()[1][0]
    assert failed["status"] == "FAILED" and api.get_error(failed["queryId"]) == (200, reply)
    assert api.get_query(failed["queryId"])[1]["isResultAvailable"] is False
    assert rows(api, of("t", columns[0][0])) == []
    assert not list((engine.root / "tables").rglob("*.parquet"))


def test_copy_missing_table_or_file(api, tmp_path):
    assert api.post_query(copy(file(tmp_path, "1\n"), name="none"))[0] == 400
    api.put_table(table(("id", "INT64")))
    assert api.post_query(copy(tmp_path / "absent.csv"))[1]["problems"][0]["error"] == "The file at this path does not exist"


def test_select_lifecycle_and_results(api, tmp_path):
    api.put_table(table(("id", "INT64")))
    api.post_query(copy(file(tmp_path, "10\n20\n30\n")))
    definition = select(of("t", "id"), op("GREATER_THAN", col("id"), lit(15)), orderByClause=[{"columnIndex": 0, "ascending": False}])
    status, query_id = api.post_query(definition)
    assert status == 200
    assert api.get_query(query_id)[1] == {
        "queryId": query_id, "status": "COMPLETED", "isResultAvailable": True, "queryDefinition": definition["queryDefinition"],
    }
    assert api.get_result(query_id)[1] == [{"rowCount": 3, "columns": [[30, 20, 10], [True, True, False]]}]
    assert api.get_result(query_id, {"rowLimit": 1, "flushResult": False})[1] == [{"rowCount": 1, "columns": [[30], [True]]}]
    assert api.get_result(query_id, {"rowLimit": 0})[1][0]["rowCount"] == 3
    assert api.get_error(query_id)[0] == 400
    assert api.get_result(query_id, {"flushResult": True})[0] == 200
    assert api.get_result(query_id)[0] == 400
    assert api.get_result("1")[0] == api.get_error("1")[0] == api.get_query("x")[0] == 404


def test_without_waiting_a_query_is_polled(api, engine):
    status, query_id = api.post_query(select(lit(1)), wait=False)
    assert status == 200
    engine.pool.shutdown(wait=True)
    assert api.get_query(query_id)[1]["status"] == "COMPLETED"


@pytest.mark.parametrize(
    "definition",
    [
        {}, {"columnClauses": []}, {"tableName": "t"}, {"columnClauses": [of("u", "id")]}, {"columnClauses": [of("t", "ID")]},
        {"columnClauses": [of("t", "id"), of("u", "id")]}, {"columnClauses": [of("t", "id")], "whereClause": col("id")},
        {"columnClauses": [of("t", "id")], "orderByClause": [{"columnIndex": 1}]},
        {"columnClauses": [of("t", "id")], "orderByClause": [{"columnName": "s"}]},
        {"columnClauses": [of("t", "id")], "orderByClause": [{"columnIndex": 0, "direction": "up"}]},
        {"columnClauses": [of("t", "id")], "limitClause": {"limit": -1}},
        {"columnClauses": [op("DIVIDE", of("t", "id"), lit(0))]}, {"columnClauses": [op("ADD", of("t", "id"), lit(2**63 - 1))]},
    ],
)
def test_bad_selects(api, tmp_path, definition):
    api.put_table(table(("id", "INT64"), ("s", "VARCHAR")))
    api.post_query(copy(file(tmp_path, "1,a\n")))
    status, reply = api.post_query({"queryDefinition": definition})
    assert status == 400 and reply["problems"]


def test_fixed_quirks(api, tmp_path):
    api.put_table(table(("a", "INT64"), ("A", "INT64")))
    api.post_query(copy(file(tmp_path, "1,2\n0,5\n")))
    got = rows(api, of("t", "a"), col("A"), orderByClause=[{"columnName": "A", "direction": "asc"}])
    assert got == [[1, 0], [2, 5]]
    # WHERE guards the division
    guarded = rows(api, op("DIVIDE", lit(4), of("t", "a")), whereClause=op("NOT_EQUAL", col("a"), lit(0)))
    assert guarded == [[4]]
    assert rows(api, lit(1), limitClause={"limit": 0}) == []


def test_state_survives_and_broken_state_is_empty(spark, tmp_path):
    from quernstone.api import Api
    from quernstone.engine import Engine

    first = Api(Engine(spark, tmp_path / "r"))
    first.put_table(table(("id", "INT64")))
    first.post_query(copy(file(tmp_path, "5\n")))
    again = Api(Engine(spark, tmp_path / "r"))
    assert rows(again, of("t", "id")) == [[5]] and len(again.get_queries()[1]) == 2
    (tmp_path / "r" / "catalog.json").write_text("{")
    assert Api(Engine(spark, tmp_path / "r")).get_tables() == (200, [])


def test_http(api, tmp_path):
    from quernstone.server import serve

    server = serve(api, 0, "127.0.0.1")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, **headers):
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, headers, method=method)
        try:
            with urllib.request.urlopen(request) as reply:
                text = reply.read()
                return reply.status, json.loads(text) if text else ""
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    table_id = call("PUT", "/table", table(("id", "INT64")))[1]
    assert call("GET", f"/table/{table_id}")[0] == 200 and call("GET", "/tables")[1][0]["tableId"] == table_id
    assert call("POST", "/query", copy(file(tmp_path, "1\n2\n")))[0] == 200
    query_id = call("POST", "/query", select(of("t", "id")))[1]
    assert call("GET", f"/query/{query_id}")[1]["status"] == "COMPLETED"
    assert call("GET", f"/result/{query_id}", {"rowLimit": 1})[1][0]["rowCount"] == 1
    assert call("GET", f"/result/{query_id}") == (200, [{"rowCount": 2, "columns": [[1, 2]]}])
    assert call("GET", f"/result/{query_id}", b"{")[0] == 404
    assert call("POST", "/query", b"{")[0] == 400 and "problems" in call("POST", "/query", b"{")[1]
    assert call("GET", f"/error/{query_id}")[0] == 400 and call("GET", "/query/abc")[0] == 404
    info = call("GET", "/system/info")[1]
    assert {"interfaceVersion", "version", "author", "uptime"} <= set(info)
    assert call("DELETE", f"/table/{table_id}") == (200, "") and call("GET", "/nothing")[0] == 404
    assert len(call("GET", "/queries")[1]) == 2
    status, late = call("POST", "/query", select(of("u", "id")), Prefer="respond-async")
    assert status == 200
    for _ in range(100):
        state = call("GET", f"/query/{late}")[1]["status"]
        if state in ("COMPLETED", "FAILED"):
            break
        time.sleep(0.1)
    assert state == "FAILED" and "problems" in call("GET", f"/error/{late}")[1]
    server.shutdown()


def test_broken_state_is_set_aside(engine):
    engine.catalog.create("t", [("id", Type.INT64)])
    engine.catalog.state.path.write_text("{broken")
    assert engine.catalog.tables() == []
    engine.catalog.create("u", [("id", Type.INT64)])
    assert [t.name for t in engine.catalog.tables()] == ["u"]
    aside = list(engine.root.glob("catalog.json.broken-*"))
    assert len(aside) == 1 and aside[0].read_text() == "{broken"
