"""All registered queries; importing this package fills core.QUERIES and core.SQL."""

from importlib import import_module

for _name in ("algebra", "zonal", "focal", "shapes", "terrain", "routing", "decisions", "calendars", "documents", "tables", "chains", "survey", "network", "control", "areas", "parties"):
    import_module(f"{__name__}.{_name}")
