from ..plans import forests as graph_parts  # noqa: F401
