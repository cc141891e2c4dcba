import pytest

from scriptloom.js import paths
from scriptloom.js.ask import is_string
from scriptloom.js.pipeline import Options, rewrite
from scriptloom.sources.sinks import UnsafePath, save_bundle_files

HEAD = "!function(e){var t={};function n(r){if(t[r])return t[r].exports;var o=t[r]={i:r,l:!1,exports:{}};return e[r].call(o.exports,o,o.exports,n),o.l=!0,o.exports}n(n.s=0)}"


def codes(code, **options):
    b = rewrite(code, Options(**options)).bundle
    return b and {k: m.code for k, m in b.modules.items()}


def test_webpack_4_array_and_object():
    assert codes(HEAD + "([function(e,t,n){n(1);n(9)},function(e,t){e.exports=2}])") == {"0": 'require("./1.js");\nrequire(/*missing*/"./9.js");', "1": "module.exports = 2;"}
    assert list(codes(HEAD + "({b:function(e){},0:function(e){},2:(e,t)=>{t.x=1}})")) == ["0", "2", "b"]


def test_webpack_5_without_entry():
    code = "(()=>{var m={7:(e,t,r)=>{r(8)},8:e=>{e.exports=1}};var c={};function q(i){var o=c[i];if(o!==undefined)return o.exports;var x=c[i]={exports:{}};m[i](x,x.exports,q);return x.exports}})();"
    b = rewrite(code).bundle
    assert (b.type, b.entry_id, b.modules["7"].code) == ("webpack", "", 'require("./8.js");')


def test_chunks_are_never_entries():
    b = rewrite("(window.webpackJsonp=window.webpackJsonp||[]).push([[1],{a:function(e,t,n){n('b')},b:function(e){}}])").bundle
    assert b.entry_id == ""
    assert b.modules["a"].code == 'require("./b.js");'


def test_modules_with_exports():
    out = codes(HEAD + "([function(e,t,n){const a=n(1);const d=n.n(a);const c=n(2);const q=n.n(c);d()(q.a)},function(e,t,n){n.r(t);n.d(t,'default',function(){return f});n.d(t,'x',function(){return y});function f(){}const y=1},function(e){e.exports=3}])")
    assert out["0"] == 'const a = require("./1.js");\nconst d = a.default;\nconst c = require("./2.js");\nconst q = c;\nd(q);'
    assert out["1"] == "export default function f() {}\nexport const x = 1;"


def test_var_injections():
    out = codes(HEAD + "([function(e,t,n){(function(g){g.x=1}).call(this,n(1))},function(e){}])")
    assert out["0"] == 'var g = require("./1.js");\ng.x = 1;'


def test_browserify_paths_and_external_names():
    code = "(function(){})()({1:[function(require,module,exports){require('./b')},{'./b':2,'ext':undefined,'lib':3}],2:[function(r,m,e){m.exports=1},{}],3:[function(){},{}]},{},[1]);"
    b = rewrite(code).bundle
    assert b.type == "browserify"
    assert {k: m.path for k, m in b.modules.items()} == {"1": "index.js", "2": "b.js", "3": "node_modules/lib/index.js"}
    assert b.modules["2"].code == "module.exports = 1;"
    assert b.modules["1"].dependencies == {"2": "./b", "3": "lib"}


def test_trees():
    tree = {"main": {"7": "./views/start", "9": "dates"}, "7": {"8": "../../shared/log.js", "3": "./parts/menu"}, "3": {"8": "../../../shared/log.js"}, "9": {"12": "./zones/table"}, "8": {"12": "dates/zones"}}
    assert paths.resolve_tree(tree, "main") == {"main": "tmp0/index.js", "7": "tmp0/views/start.js", "3": "tmp0/views/parts/menu.js", "8": "shared/log.js", "9": "node_modules/dates/index.js", "12": "node_modules/dates/zones/index.js"}
    ring = {"x": {"y": "./one"}, "y": {"z": "./deep/two"}, "z": {"x": "../", "y": "../one"}}
    assert paths.resolve_tree(ring, "x") == {"x": "index.js", "y": "one.js", "z": "deep/two.js"}
    assert paths.resolve_tree({}, "only") == {"only": "index.js"}
    up = {"e": {"p": "../../../far", "q": "../near"}}
    assert paths.resolve_tree(up, "e") == {"e": "tmp0/tmp1/tmp2/index.js", "p": "far.js", "q": "tmp0/tmp1/near.js"}


@pytest.mark.parametrize(("source", "target", "name"), [
    ("lib/core/run.js", "lib/core/stop.js", "./stop.js"), ("lib/core/run.js", "lib/util.js", "../util.js"), ("start.js", "./lib/util.js", "./lib/util.js"),
    ("a/b/c.js", "d/e.js", "../../d/e.js"), ("a/../b/c.js", "./b/x/../y.js", "./y.js"), ("views/start.js", "node_modules/dates/index.js", "dates/index.js"),
])
def test_names_by_the_way(source, target, name):
    assert paths.relative(source, target) == name


def test_keys_and_normal_paths():
    assert paths.key_order(["z", "04", "30", "4", "m", "0"]) == ["0", "4", "30", "z", "04", "m"]
    assert [paths.join(*p) for p in (("a", "", "b/./c"), ("a/..",), ("..", "x"), ("a", "../../y"))] == ["a/b/c", ".", "../x", "../y"]
    assert [paths.escapes(p) for p in ("a/../b", "a/../../b", "..", "C:\\x", "x..y/z")] == [False, True, True, True, False]


def test_mappings():
    code = HEAD + "([function(e){e.exports='one'},function(e){e.exports='two'}])"
    b = rewrite(code, Options(mappings={"lib/two.js": lambda n: is_string(n) and n.value == "two"})).bundle
    assert b.modules["1"].path == "./lib/two.js"
    with pytest.raises(ValueError, match="several"):
        rewrite(code, Options(mappings={"x": is_string}))


def test_files_and_the_guard(tmp_path):
    b = rewrite(HEAD + "([function(e){e.exports=1}])").bundle
    save_bundle_files(b, str(tmp_path / "out"))
    assert (tmp_path / "out" / "index.js").read_text() == "module.exports = 1;"
    assert (tmp_path / "out" / "bundle.json").exists()
    for bad in ("../x", "..\\..\\x", "/etc/x"):
        b.modules["0"].path = bad
        with pytest.raises(UnsafePath):
            save_bundle_files(b, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
