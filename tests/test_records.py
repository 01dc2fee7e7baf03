"""Strict records: reading, matching, projecting, mutating."""

import pytest

from recordsieve.lang.errors import RecordError
from recordsieve.records import reader
from recordsieve.records.program import program


def hits(selector, records, **how):
    run = program(selector, **how).runner()
    return sum(run(r)[0] for r in records)


SCALARS = ['{"v":%s}' % x for x in ["1", '"1"', "true", '"true"', "null", '"null"', "false", '"false"', '"x"']]
NUMBERS = ['{"v":%s}' % x for x in ["1", "1.0", '"1"', '"1.0"', "10", "1e1", '"10"', '"1e1"', "0.1", "1e-1", "0", '"00"', "9007199254740992", "9007199254740993"]]
PRESENT = ['{"x":null,"status":""}', '{"x":"v","status":"open"}', '{"status":""}', '{"x":{},"status":null}']
TIMES = ['{"ts":"2026-03-05T10:29:00+01:00"}', '{"ts":"2026-03-05T10:29:00Z"}', '{"ts":"2026-03-05"}', '{"ts":5}']
NESTED = ['{"o":{"0":{"s":"x"}},"a":[{"s":"x"}]}', '{"a":[[{"s":"x"}]]}', "5"]


@pytest.mark.parametrize(
    ("records", "selector", "n"),
    [
        (SCALARS, "/v=1", 1), (SCALARS, '/v="1"', 1), (SCALARS, "/v=null", 1), (SCALARS, "in{f=/v,any=1|true|null|false|x}", 5),
        (NUMBERS, "/v=1", 2), (NUMBERS, "/v=1e1", 2), (NUMBERS, "/v=00", 1), (NUMBERS, "/v>9007199254740992", 1), (NUMBERS, "/v=9007199254740993", 1),
        (PRESENT, "eq{f=/status}", 2), (PRESENT, "contains{f=/x}", 3), (PRESENT, "exists{/x}", 2), (PRESENT, "/x!=v", 3),
        (TIMES, '/ts="2026-03-05T09:29:00Z"', 2), (TIMES, "/ts>=2026-03-05T10:00:00Z", 1), (TIMES, "date{f=/ts,value=2026-03-05}", 3),
        (NESTED, '/o/*/s="x"', 1), (NESTED, '/a/[]/s="x"', 1), (NESTED, '/a/*/s="x"', 0), (NESTED, '/.../s="x"', 2), (NESTED, "exists{/...}", 2), (NESTED, "/q!=1", 2), (NESTED, "not.eq{f=/q,v=1}", 3),
        (['{"m":"Ångström"}'], "icontains{f=/m,v=å}", 1), (['{"m":"\u212aey"}'], "iprefix{f=/m,v=k}", 1),
        (['{"code":1,"code":2}', '{"code":1}'], "/code=1", 2),
    ],
)
def test_selection(records, selector, n):
    assert hits(selector, records) == n


@pytest.mark.parametrize("text", ['{"a":01}', '{"a":NaN}', '{"a":"\\ud800"}', '{"a":1,}', '{"a":"\x01"}', "[1]", '{"a":1} x', "{a:1}", "[" * 200, '{"a":' * 130 + "1" + "}" * 130])
def test_strict(text):
    with pytest.raises(RecordError):
        reader.quick(text)
    with pytest.raises(RecordError):
        reader.tree(text)


def test_frames():
    assert list(reader.frames(' {"a" : 1,\n"b":2}\n\n{"c":3} \r\n5')) == ['{"a" : 1,\n"b":2}', '{"c":3}', "5"]
    with pytest.raises(RecordError):
        list(reader.frames('{"a":1} {"b":2}'))
    got = []
    with pytest.raises(RecordError):
        for r in reader.frames('{"a":1}\n{"b":\n'):
            got.append(r)
    assert got == ['{"a":1}']


def test_spelling_is_kept():
    run = program("/n=1.50").runner()
    assert run('{ "n" : 1.5e0 , "k\\u0041": "a b" }')[1] == '{"n":1.5e0,"k\\u0041":"a b"}'


def test_projection():
    record = '{"id":1,"meta":{"trace":"t","ignore":2},"items":[{"sku":"A"},{"sku":"B"}],"slash/key":3}'
    run = program(fields=["/meta/trace", "/items/1/sku", "/id", "/slash~1key"]).runner()
    assert run(record) == (True, '{"id":1,"items":[null,{"sku":"B"}],"meta":{"trace":"t"},"slash/key":3}')
    assert program(fields=["/missing"]).runner()(record) == (True, None)
    assert program(fields=["/a/0", "/a/x"]).runner()('{"a":[10,20]}')[1] == '{"a":[10]}'
    for bad in ('{"a":{"0":1,"x":2}}', "1"):
        with pytest.raises(RecordError):
            program(fields=["/a/0", "/a/x"]).runner()(bad)


#: By rule: a record, mutations, and the record that comes of it.
MUTATIONS = {
    "steps": [('{"q":4}', "/q++", '{"q":5}'), ('{"q":4}', "/q--", '{"q":3}'), ('{"q":4}', "/q=-3", '{"q":1}'), ('{"q":4}', "/q=+0.5", '{"q":4.5}'), ('{"q":0.1}', "/q=+0.2", '{"q":0.30000000000000004}')],
    "a missing number starts at the step": [('{"q":4}', "/r=+2.5", '{"q":4,"r":2.5}'), ("{}", "/lamp/watts=-40", '{"lamp":{"watts":-40}}')],
    "steps of one key add up": [('{"q":4}', "/q=+0.5\n/q=+0.25", '{"q":4.75}')],
    "removal": [('{"q":4,"r":5}', "rm:/q", '{"r":5}'), ('{"q":4,"r":5}', "remove:/r", '{"q":4}'), ('{"q":4}', "delete:/q", "{}"), ('{"q":{"r":1,"s":2}}', "del:/q/r", '{"q":{"s":2}}'), ('{"q":4}', "rm:/none", '{"q":4}')],
    "an element that goes leaves null": [('{"l":[7,8,9]}', "rm:/l/1", '{"l":[7,null,9]}'), ('{"l":[{"x":1,"y":2}]}', "rm:/l[]/x", '{"l":[{"y":2}]}')],
    "kinds of values": [("{}", ["/t=\"7\"", "/u='x y'", "/v=TRUE", "/w=", "/y=abc", "/z=1.50"], '{"t":"7","u":"x y","v":true,"w":"","y":"abc","z":1.50}')],
    "several in one text": [("{}", "/a=1,/b=2", '{"a":1,"b":2}'), ("{}", "/a=x,y", '{"a":"x,y"}'), ('{"c":3}', "/a=1,rm:/c", '{"a":1}')],
    "braces prefix paths": [("{}", "/k{/l=1,/m{/n=2}}", '{"k":{"l":1,"m":{"n":2}}}')],
    "escapes": [("{}", "/sl~1ash=1", '{"sl/ash":1}'), ("{}", "/ti~0lde=2", '{"ti~lde":2}')],
    "keys keep their places": [('{"d":1,"e":2,"d":3}', "/d=9", '{"d":9,"e":2,"d":9}'), ('{"z":0}', ["/m=1", "/b=2"], '{"z":0,"m":1,"b":2}')],
    "actions act in order": [('{"p":0,"q":0}', ["/p=4", "/*=7", "/q=5"], '{"p":7,"q":5}'), ('{"p":1}', ["/v=1", "/v=2"], '{"p":1,"v":2}')],
    "a parent that is no object becomes one": [('{"lamp":[1]}', "/lamp/on=true", '{"lamp":{"on":true}}'), ('{"lamp":"x"}', "/lamp/watts=+40", '{"lamp":{"watts":40}}'), ('{"lamp":null}', "/lamp/a/b=1", '{"lamp":{"a":{"b":1}}}')],
    "a wildcard makes nothing": [('{"h":3}', ["/h/*=1", "/g/**/x=1", "/h/...=2"], '{"h":3}')],
    "below a wildcard": [('{"g":{"x":[1,2],"y":3}}', "/g/*/1=8", '{"g":{"x":[1,8],"y":3}}'), ('{"g":{"x":{"n":1},"y":{"n":2}}}', "/g/*/n++", '{"g":{"x":{"n":2},"y":{"n":3}}}'), ('{"rows":[{"v":1},{"v":2},5]}', "/rows[]/v=0", '{"rows":[{"v":0},{"v":0},5]}')],
    "a leading wildcard may make a member": [('{"c":{"on":1},"d":4}', "/*/off=2", '{"c":{"on":1,"off":2},"d":4}')],
    "at every depth": [('{"id":1,"sub":{"id":2,"deep":[{"id":3}]}}', "/.../id=0", '{"id":0,"sub":{"id":0,"deep":[{"id":0}]}}'), ('{"id":1,"sub":{"id":2}}', "rm:/.../.../id", '{"sub":{}}')],
}
MUTATIONS = [pytest.param(*case, id=f"{rule}: {case[1]}") for rule, cases in MUTATIONS.items() for case in cases]


@pytest.mark.parametrize(("record", "mutations", "want"), MUTATIONS)
def test_mutation(record, mutations, want):
    assert program(mutations=mutations).runner()(record)[1] == want


def test_mutation_errors_and_modes(tmp_path):
    with pytest.raises(RecordError):
        program(mutations="/a=+1").runner()('{"a":"x"}')
    with pytest.raises(RecordError):
        program(mutations="/a=1").runner()("5")
    run = program("/a=1", mutations="/b=2", matched_only=False).runner()
    assert [run(r)[1] for r in ('{"a":1}', '{"a": 2}', "7")] == ['{"a":1,"b":2}', '{"a":2}', "7"]
    both = program("/a=1", fields=["/a"], mutations="/b=2", matched_only=False).runner()
    assert [both(r)[1] for r in ('{"a":1,"c":1}', '{"a":2,"c":1}', '{"c":1}')] == ['{"a":1,"b":2}', '{"a":2}', None]
    (tmp_path / "t").write_text("hi\n")
    (tmp_path / "b").write_bytes(b"\x00\xff")
    got = program(mutations=["textfile:/t=t", "base64file:/b=b", "file:/f=b"], files=True, folder=str(tmp_path)).runner()("{}")[1]
    assert got == '{"t":"hi\\n","b":"AP8=","f":"AP8="}'
    with pytest.raises(RecordError):
        program(mutations="textfile:/t=b", files=True, folder=str(tmp_path))
