"""Parameters, cursors, periods and the config: what stands around the queries."""

from datetime import datetime

import pytest

from meterlake.functions import config
from meterlake.functions.config import Config, ModelAlias, Override
from meterlake.operators import events, reports
from meterlake.operators.filters import Filters, parsed
from meterlake.session import shared_folder


def test_filters_from_parameters():
    f = parsed(harness="pi, codex,", provider=["a,b", "c"], model=None, project="", since="2026-01-01", until="", session=None)
    assert f == Filters(since="2026-01-01", harness=("pi", "codex"), provider=("a", "b", "c"))


@pytest.mark.parametrize("sort", events.SORTS)
def test_cursors(sort):
    value = {"oldest": "2026-01-01 00:00:00", "recent": "2026-01-01 00:00:00", "model": "a|b"}.get(sort, "42")
    assert events.decode_cursor(events.encode_cursor(value, "id"), sort) == (value, "id")
    for bad in ("", "a b", "x" * 1025, "é", events.encode_cursor("1", ""), events.encode_cursor("", "id").replace("=", "")[:2]):
        with pytest.raises(ValueError):
            events.decode_cursor(bad, sort)


def test_numbers_only_in_cursors_of_numbers():
    for sort in ("largest", "fresh", "cache", "output", "cost"):
        with pytest.raises(ValueError):
            events.decode_cursor(events.encode_cursor("many", "id"), sort)
    assert events.decode_cursor(events.encode_cursor(None, "id"), "cost") == ("null", "id")
    with pytest.raises(ValueError):
        events.decode_cursor(events.encode_cursor(None, "id"), "fresh")


def test_presets_and_periods():
    now = datetime(2026, 10, 9, 10)
    assert reports.preset("7d", now) == Filters(since="2026-10-02T10:00:00", until="2026-10-09T10:00:00")
    assert reports.preset("1y", now).since == "2025-10-09T10:00:00" and reports.preset("all", now).since is None
    f = Filters(since="2026-10-02T10:00:00", until="2026-10-09T10:00:00")
    assert (reports.previous(f).since, reports.previous(f).until) == ("2026-09-25T10:00:00", "2026-10-02T10:00:00")
    day = reports.intersection(f, "2026-10-02T00:00:00", "2026-10-03T00:00:00")
    assert (day.since, day.until) == ("2026-10-02T10:00:00", "2026-10-03T00:00:00")


def test_config_is_saved_and_a_broken_one_set_aside(tmp_path):
    path = tmp_path / "deep" / "config.json"
    c = Config(provider_aliases=(("glm", "GLM"),), overrides=(Override("pi", "zai", since="2026-01-01"),), model_aliases=(ModelAlias("a", "b"),), project_aliases=(("p", ("/x", "/y")),), billing=(("openai", "metered"),), cutoff="2026-01-01", sources={"pi": "/logs"})
    assert config.load(path) == Config()
    config.save(c, path)
    assert config.load(path) == c and not list(path.parent.glob("*.part"))
    path.write_text("{")
    assert config.load(path) == Config() and path.with_suffix(".broken.json").read_text() == "{" and not path.exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(), "x")
