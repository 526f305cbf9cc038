import pytest

from pipewright.types import BOOL, FLOAT, INT, NULL, STRING, LType, TypeConflict, finalised, list_of, record, spark_type, unify, union_of


def test_rendering():
    t = record([("b", INT.maybe()), ("a", list_of(record([("x", FLOAT)])))])
    assert str(t) == "record<a:list<record<x:float>>, b:int?>"
    assert str(union_of([INT, STRING, NULL])) == "union<int,string>?"
    assert str(list_of(LType("mixed", True)).maybe()) == "list<mixed?>?"


def test_unify():
    assert unify(INT, FLOAT.maybe()) == FLOAT.maybe()
    assert unify(NULL, STRING) == STRING.maybe()
    assert unify(list_of(INT), list_of(STRING)) == list_of(LType("mixed"))
    assert unify(INT, STRING, in_list=True) == LType("mixed")
    assert unify(INT, STRING, permissive=True) == STRING
    assert str(unify(record([("a", INT)]), record([("a", FLOAT), ("b", BOOL)]))) == "record<a:float, b:bool?>"
    for a, b in [(INT, STRING), (BOOL, INT), (record([]), list_of(INT)), (record([("a", INT)]), record([("a", STRING)]))]:
        with pytest.raises(TypeConflict):
            unify(a, b)


def test_unions():
    assert union_of([INT, FLOAT]) == FLOAT
    assert union_of([NULL, STRING]) == STRING.maybe()
    u = union_of([INT, STRING])
    assert unify(u, STRING.maybe()) == u.maybe()
    with pytest.raises(TypeConflict):
        unify(u, BOOL)


def test_finalised():
    assert str(finalised(record([("a", NULL), ("b", list_of(NULL))]))) == "record<a:string?, b:list<string?>>"


def test_storage_sorts_fields():
    assert spark_type(record([("b", INT), ("a", STRING)])).names == ["a", "b"]
