from datetime import UTC, datetime

import pytest

from textlode.control.options import ExtractOptions, model_params, pipeline_of
from textlode.control.registry import Alias, Environment, LifeCycle, Provider, Registry, SchemaHooks, builtin_registry, load_plugins, parse_route, resolve_aliases, response_schema
from textlode.core.errors import InferenceConfigError, ProviderError
from textlode.operators.model import Model

NOW = datetime(2026, 1, 1, tzinfo=UTC)
EXAMPLES = [("Bob ran.", [("person", "Bob", {"roles": ["x"]})])]


def connect(model):
    return lambda prompt, settings: model


def registry(**more):
    r = Registry("p", now=lambda: NOW)
    r.register(Provider("p", "base", connect, **more))
    r.register(Provider("q", "other", connect, patterns=["^q-"], priority=2))
    return r


def route_of(r, **k):
    m = r.resolve(**k).models[0]
    return f"{m.provider}:{m.model_id}"


def test_routes():
    r = registry(patterns=["^q-x"], priority=5)
    assert route_of(r) == "p:base" and route_of(r, provider="q") == "q:other" and route_of(r, model="q-1") == "q:q-1"
    assert route_of(r, model="q-x1") == "p:q-x1" and route_of(r, model="q: m ") == "q:m" and route_of(r, model="zzz") == "p:zzz"
    assert route_of(r, provider="q", model="q:m") == "q:m" and route_of(r, provider="q", model="p:m") == "q:p:m"
    assert parse_route("a:") is None and r.list_patterns()[0][:2] == (5, "p")
    r.set_default("q")
    assert route_of(r) == "q:other"
    with pytest.raises(ProviderError):
        r.resolve(provider="none")
    with pytest.raises(ProviderError):
        r.register(Provider("p", "x", connect))
    with pytest.raises(ProviderError):
        r.register_pattern("none", "x")


def test_aliases_and_life_cycles(monkeypatch):
    r = registry(aliases={"base": "base-2", "old": Alias("new", LifeCycle(deprecated_after="2025-01-01"))})
    r.register_alias("base-2", "q:final")
    assert route_of(r) == "q:final"
    assert r.resolve(model="old").warnings == ['Model alias "p:old" is deprecated and currently resolves to "p:new".']
    r.register_alias("a", "b")
    r.register_alias("b", "a")
    with pytest.raises(ProviderError, match="cycle"):
        r.resolve(model="a")
    r.register_alias("gone", "x", LifeCycle(removed_after="2025-06-01T00:00:00Z", replacement="y"))
    with pytest.raises(ProviderError, match='removed. Use "y"'):
        r.resolve(model="gone")
    r.register_alias("late", "x", LifeCycle(sunset_after="2025-06-01"))
    with pytest.raises(ProviderError, match="sunset"):
        r.resolve(model="late")
    monkeypatch.setenv("TEXTLODE_ALLOW_SUNSET_ALIASES", "yes")
    assert len(r.resolve(model="late").warnings) == 1
    for k in range(20):
        r.register_alias(f"n{k}", f"n{k + 1}")
    with pytest.raises(ProviderError, match="depth"):
        r.resolve(model="n0")
    assert ("p:late", "p:x", "sunset", None) in r.list_aliases()


def test_fallbacks():
    r = registry(fallbacks={"base": ["f1", "q:f2"]})
    r.register_fallbacks("base", [" q:f2 ", "", "base"])
    assert [(m.provider, m.model_id) for m in r.resolve().models] == [("p", "base"), ("p", "f1"), ("q", "f2")]
    assert r.list_fallbacks() == [("p:base", ["q:f2", "base"])]


def test_explicit_models():
    r = registry()
    f = connect("x")
    assert route_of(r, explicit=f) == "custom:custom-model" and route_of(r, explicit=f, provider=" a ", model="b") == "a:b"
    assert r.resolve(explicit=Model("m", "n", f)).models[0].provider == "m"


def test_environment():
    r = builtin_registry()
    key, url, warnings = r.environment("openai:gpt", env={"OPENAI_API_KEY": "k1", "TEXTLODE_API_KEY": "k2"})
    assert (key, url, len(warnings)) == ("k1", None, 1)
    assert r.environment("openai:x", key="own", env={})[0] == "own"
    key, url, warnings = r.environment("ollama:llama", env={"OLLAMA_API_KEY": "k"})
    assert url.startswith("http://localhost") and len(warnings) == 1
    assert r.environment("ollama:x", env={"OLLAMA_BASE_URL": "http://far.example"})[1] == "http://far.example"


def test_hooks_and_capabilities():
    r = builtin_registry()
    assert r.capabilities("google") == {"provider": "google", "has_hooks": True, "builds_schema": True, "raw_output": True, "hooks_id": "gemini"}
    assert r.capabilities("none") is None and [p.id for p in r.list_providers()] == ["gateway", "google", "ollama", "openai"]
    s = response_schema(EXAMPLES)["responseSchema"]["properties"]["extractions"]["items"]["properties"]
    assert s["person_attributes"]["properties"] == {"roles": {"type": "array", "items": {"type": "string"}}}
    with pytest.raises(ProviderError):
        r.register(Provider("z", "x", connect, hooks=SchemaHooks(" ", True)))
    with pytest.raises(ProviderError):
        r.register(Provider("z", "x", connect, hooks=SchemaHooks("h", "yes")))


def test_plugins(monkeypatch):
    class Entry:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if isinstance(self.value, Exception):
                raise self.value
            return self.value

    r = registry()
    found = [Entry("b", lambda reg: reg.register(Provider("new", "m", connect))), Entry("a", ImportError("no")), Entry("c", 5)]
    assert load_plugins(r, found) == (["b"], [("a", "no"), ("c", "a plugin must be a function or have a register(registry) method")])
    assert "new" in r.providers
    monkeypatch.setenv("TEXTLODE_DISABLE_PLUGINS", "1")
    assert load_plugins(r, found) == ([], [])


def test_option_names():
    o = ExtractOptions.of(max_char_buffer=5, maxCharBuffer=7.9, passes=3, batch_size=4, batchLength=None, format_type=" YAML ", context="c")
    assert (o.max_char_buffer, o.extraction_passes, o.batch_length, o.format_type, o.additional_context) == (7, 3, 4, "yaml", "c")
    assert ExtractOptions.of(extraction_passes=2, passes=3).extraction_passes == 2 and ExtractOptions.of(maxWorkers=0).max_workers == 1
    with pytest.raises(TypeError):
        ExtractOptions.of(nonsense=1)


def test_model_precedence_and_settings():
    r = builtin_registry()
    f = connect("x")
    pick = lambda **k: ExtractOptions.of(registry=r, examples=EXAMPLES, **k).resolve_model().models[0]
    assert pick(model=f, config={"model": connect("y")}).provider == "custom"
    assert pick(config={"model_id": "openai:c"}, model_id="openai:d").model_id == "c" and pick(model_id="gpt-4x").provider == "openai"
    o = ExtractOptions.of(registry=r, examples=EXAMPLES, provider="google", config={"settings": {"seed": 1, "temperature": 9}}, settings={"seed": 2}, temperature=0, api_key="k", language_model_params={"topK": 3, "odd": 1, "reasoning_effort": None})
    s = o.model_settings(o.resolve_model())
    own = s["provider_options"]["google"]
    assert (s["seed"], s["temperature"], own["apiKey"], own["topK"], "odd" in own, "responseSchema" in own) == (2, 0, "k", 3, False, True)
    assert o.fences(o.resolve_model()) is False and ExtractOptions.of(registry=r).fences(o.resolve_model()) is True


def test_model_params():
    assert model_params({"reasoning_effort": "high", "reasoning": {"a": 1}, "response_format": "x", "n": None}, "openai") == {"reasoning": {"a": 1, "effort": "high"}, "responseFormat": "x"}


def test_checks_of_a_run():
    said = []
    with pytest.raises(InferenceConfigError):
        pipeline_of(ExtractOptions.of())
    pipeline_of(ExtractOptions.of(registry=builtin_registry(), examples=EXAMPLES, provider="google", fence_output=True, resolver_params={"require_extractions_key": False}, on_warning=said.append))
    assert [w.code for w in said] == ["schema_fences_incompatible", "schema_wrapper_incompatible"]
    said.clear()
    pipeline_of(ExtractOptions.of(registry=builtin_registry(), examples=[("Open AI", [("o", "openai", None)])], on_warning=said.append))
    assert [w.code for w in said] == ["prompt_alignment_non_exact"]
    with pytest.raises(InferenceConfigError):
        pipeline_of(ExtractOptions.of(examples=EXAMPLES, resolver_params={"fuzzy_alignment_threshold": 2}))


def test_alias_tables(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), (None, "z"), ("n", None), ("a", "b")] + [(f"k{i}", f"k{i + 1}") for i in range(20)]
    got = {r.alias: (r.target, r.hops) for r in resolve_aliases(spark.createDataFrame(rows, "alias string, target string")).collect()}
    assert got["a"] == ("c", 2) and got["b"] == ("c", 1) and got["x"] == (None, None) and got["k19"] == ("k20", 1) and got["k4"] == ("k20", 16) and got["k3"] == (None, None)


def test_environment_defaults():
    assert Environment().key_names == ()
