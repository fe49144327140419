"""Registered queries over the shared tables."""


def load_catalog():
    """The registry, with every query module imported."""
    from plantscope.plans import catalog, intake, learning, regression, relations, shape, similar  # noqa: F401

    return catalog
