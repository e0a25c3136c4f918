"""Names of the library's queries, with the SQL that states the same result."""

from importlib import import_module

from gridloom.plans import views

FLAGSHIP = "power_summary"
_AREAS = ("classify", "layers", "geometry", "hexes", "tiles", "quality", "governance", "snapshots", "reviews", "files", "areas", "graphs", "landed", "requests")


def _load() -> None:
    for area in _AREAS:
        import_module(f"gridloom.plans.{area}")


def queries() -> dict:
    _load()
    return dict(views.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(views.SQL)
