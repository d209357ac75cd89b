"""The entry points where parts are missing."""

import builtins

import pytest

import __spark_entry__ as entry
from docketry.session import work_folder


@pytest.mark.parametrize("package", ["public_tokenizers", "regex", "docketry.llm"])
def test_core_queries_stay_without_a_package(monkeypatch, package):
    import sys

    for name in [m for m in sys.modules if m.split(".")[0] in (package, "corpus_pipeline") or m.startswith("docketry.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def without(name, *rest, **more):
        if name == package or name.startswith(f"{package}."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *rest, **more)

    monkeypatch.setattr(builtins, "__import__", without)
    known = entry.queries()
    assert "parse_flow" in known and not any(q.startswith("op") or q == "pipeline" for q in known)
    assert set(entry.oracle_sql()) <= set(known)


def test_driver_folder_is_refused_on_a_cluster(monkeypatch):
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}.get(key, default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        work_folder(Session, "x")
    Session.sparkContext.master = "local[4]"
    assert work_folder(Session, "x").startswith("file:/tmp/warehouse/.work/x-")
