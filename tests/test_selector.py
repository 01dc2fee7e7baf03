"""The selector language: trees, rejections, JSON spelling, builders."""

import pytest

from recordsieve.lang import mutation, numbers, projection, temporal
from recordsieve.lang import selector as S
from recordsieve.lang.errors import ExpressionError

#: Expressions that break one rule each.
REJECTED = {
    "a quote stays open": ['/owner="ann', "/owner='ann", 'iprefix{f=/owner,v="an}'],
    "a brace stays open or closes twice": ["range{f=/weight,gt=2", "exists{/owner}}"],
    "an operator needs a path before it": ["owner=ann", "=ann", "plain words"],
    "a comparison needs a number or a time": ["/weight<", "/weight>=heavy", "/weight<'3'"],
    "no such operator": ["between{f=/weight,gt=1,lt=2}", "Eq{f=/owner,v=ann}"],
    "no such key of the operator": ["eq{f=/owner,gt=3}", "iprefix{f=/owner,any=a|b}", "range{f=/weight,since=now}", "in{f=/tier,any=1,ic=t}"],
    "a field is needed": ["eq{v=ann}", "icontains{any=a|b}", "range{lt=4}", "date{before=2030-01-01}", "in{any=1}"],
    "exists takes a path alone": ["exists{}", "exists{f=/owner}", "exists{/owner,v=1}"],
    "a key has one value": ["eq{f=/owner,v=1,v=2}", "eq{f=/owner,field=/tier,v=1}"],
    "alternatives cannot all be empty": ["contains{f=/owner,any=|}", "in{f=/tier}", "in{f=/tier,any=|||}"],
    "alternatives of in are exact": ["in{f=/tier,any=1 |2}", "in{f=/tier,any= 1}"],
    "alternatives exclude a value": ["icontains{f=/owner,v=a,any=b}"],
    "a flag is true or false": ["prefix{f=/owner,v=a,ic=2}", "contains{f=/owner,v=a,ignoreCase=si}"],
    "a group has a number": ["or.-1.exists{/owner}", "and.one.exists{/owner}", "or..exists{/owner}"],
    "a numbered group has one predicate of a kind": ["or.2.exists{/owner},or.2.exists{/tier}", "and.0.not.in{f=/tier,any=1},and.0.not.in{f=/tier,any=2}"],
    "a range needs a bound": ["range{f=/weight}", "date{f=/seen}"],
    "bounds are of one kind": ["range{f=/weight,lt=3,gte=2024-05-05}"],
    "a range has no words for times": ["range{f=/seen,lt=today}"],
    "a date has no numbers": ["date{f=/seen,after=7}", "date{f=/seen,value=7}"],
    "since stands alone": ["date{f=/seen,since=now,before=2030-01-01}", "date{f=/seen,since=soon}"],
    "a side has one bound": ["date{f=/seen,before=2030-01-01,lt=2031-01-01}"],
    "a time has a whole zone": ["range{f=/seen,gt=2024-05-05T10:00:00-03:}", "range{f=/seen,gt=2024-05-05T10:00:00+2400}"],
}


@pytest.mark.parametrize("text", [pytest.param(x, id=f"{rule}: {x}") for rule, found in REJECTED.items() for x in found])
def test_rejected(text):
    with pytest.raises(ExpressionError):
        S.parse(text)


def test_repeated_keys_of_one_value():
    assert S.parse("eq{f=/owner,field=/owner,v=ann,value=ann}") == S.parse("/owner=ann")


@pytest.mark.parametrize(
    "text",
    [
        "", "7", '"eq"', "{}{}", '{"nor":[]}', '{"or":{"eq":{"field":"/tier","value":1}}}', '{"exists":{"field":"/tier"}}',  # no object, or no known operator in its form
        '{"exists":"/tier","prefix":{"field":"/tier","value":"a"}}',  # two operators in one object
        '{"in":{"field":"/tier","any":[]}}', '{"range":{"field":"/weight"}}', '{"range":{"field":"/weight","lt":"4x"}}',  # the rules of the text form hold
        '{"eq":{"field":"/tier","value":1,"value":2}}', r'{"exists":"/ti\u0000er"}',
    ],
)
def test_rejected_json(text):
    with pytest.raises(ExpressionError):
        S.from_json(text)


@pytest.mark.parametrize(
    ("text", "json"),
    [
        ("", "{}"),
        ("/", "{}"),
        ("contains{f=/}", "{}"),
        ("icontains{f=/...}", "{}"),
        (' \n/status = "open" \n', '{"eq":{"field":"/status","value":"open"}}'),
        ("/enabled='true'", '{"eq":{"field":"/enabled","value":"true"}}'),
        ("/n=1.50", '{"eq":{"field":"/n","value":1.50}}'),
        ("/a!=x", '{"not":{"eq":{"field":"/a","value":"x"}}}'),
        ("/items[]/sku=A", '{"eq":{"field":"/items/[]/sku","value":"A"}}'),
        ("contains{f=/m,v=x,ic=t}", '{"icontains":{"field":"/m","value":"x"}}'),
        ('prefix{f=/m,v=""}', '{"prefix":{"field":"/m","value":""}}'),
        ("prefix{f=/m}", '{"prefix":{"field":"/m"}}'),
        ("date{f=/t,after=2025-01-01,b=2025-02-01}", '{"date":{"field":"/t","gt":"2025-01-01","lt":"2025-02-01"}}'),
        ("/f=v,/s=ok,or.eq{f=/m,v=ok},or.1.eq{f=/m,v=done}", '{"and":[{"eq":{"field":"/f","value":"v"}},{"eq":{"field":"/s","value":"ok"}},{"or":[{"eq":{"field":"/m","value":"ok"}},{"eq":{"field":"/m","value":"done"}}]}]}'),
        ("and.0.or.0.and.0.eq{f=/s,v=o},and.0.or.0.and.0.range{f=/p,gte=10}", '{"and":[{"or":[{"and":[{"eq":{"field":"/s","value":"o"}},{"range":{"field":"/p","gte":10}}]}]}]}'),
        ("or.0.and.0.not.exists{/m}", '{"or":[{"and":[{"not":{"exists":"/m"}}]}]}'),
    ],
)
def test_tree(text, json):
    assert S.to_json(S.parse(text)) == json
    assert S.to_json(S.from_json(json)) == json


def test_builders_match_text():
    assert S.eq("/a", "x") == S.parse("/a=x")
    assert S.within("/n", gte=1) == S.parse("/n>=1")
    assert S.exists("/a") == S.parse("exists{/a}")
    assert S.dated("/t", since="Today").since == "today"
    assert S.text_match("contains", "/a", any_of=["x", "y"]) == S.parse("contains{f=/a,any=x|y}")
    assert [c.text for c in S.member("/a", ["1"]).any] == ["1"]
    assert S.parse("/a=1,not.exists{/b}").features == {"and", "eq", "not", "exists"}


def test_exact_numbers():
    assert numbers.compare("1e9223372036854775808", "1e9223372036854775809") < 0
    assert numbers.compare("-0", "0.00") == 0
    assert numbers.compare("9007199254740993", "9007199254740992.0") > 0
    assert numbers.compare("-11", "-1") < 0 < numbers.compare("11", "1")


def test_exponents_of_any_length():
    far = "1e" + "9" * 5000
    assert numbers.compare(far, "1e999") > 0 > numbers.compare("-" + far, far)
    assert numbers.compare(far, "10e" + "9" * 4999 + "8") == 0
    assert numbers.compare("1e-" + "9" * 5000, "0") > 0
    assert numbers.floor_at("-2.5", 0) == (-3, False) and numbers.floor_at("2.50", 1) == (25, True) and numbers.floor_at("-1e-9", 2) == (-1, False)


def test_years_at_the_ends():
    assert temporal.utc_text(temporal.parse("0001-01-01T02:00:00+05:00")) == "0000-12-31T21:00:00Z"
    assert temporal.utc_text(temporal.parse("9999-12-31T23:59:59Z")) == "9999-12-31T23:59:59Z"
    assert temporal.civil(temporal.parse("9999-12-31T23:59:59-10:00").seconds) == (10000, 1, 1, 9, 59, 59)
    assert temporal.civil(temporal.parse("0000-01-01").seconds - 1)[:3] == (-1, 12, 31)


def test_times():
    assert temporal.parse(" 2024-02-29 ").date_only
    assert temporal.parse("2023-02-29") is None
    assert temporal.parse("2024-01-01T00:00:60Z") is None
    assert temporal.parse("2024-01-01T00:00:00+24:00") is None
    assert temporal.parse("2024-01-01T00:00:00", strict=True) is None
    assert temporal.utc_text(temporal.parse("2024-01-01T01:00:00.1230+01:00")) == "2024-01-01T00:00:00.123Z"
    assert temporal.parse("2024-01-01T00:00:00.1234567899Z").nanos == 123456789


@pytest.mark.parametrize("paths", [["/meta", "/meta/x"], ["/0/id"], ["x"], ["/a/0", "/a/00"], [" "]])
def test_rejected_projection(paths):
    with pytest.raises(ExpressionError):
        projection.parse(paths)


@pytest.mark.parametrize("text", ["/n=01", "/n=nan", "/n=inf", "/n=+0", "/n=-0", "/n=1e9999", "/=value", "/d=2025-01-01", "file:/a=x", "time:/a=2024-01-01", "time:/a=2024-01-01T00:00:00,5Z", "time:/a=9999-12-31T23:59:59-05:00", "time:/a=0000-01-01T00:00:00+00:01", "", "zap:/a=1"])
def test_rejected_mutation(text):
    with pytest.raises(ValueError):
        mutation.parse(text)
