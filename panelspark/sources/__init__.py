from . import catalogue, climate, containers, links, sections, tables, typed, weather  # noqa: F401
