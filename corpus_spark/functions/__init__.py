"""Column functions: every name here maps ``Column`` to ``Column`` and keeps rows apart."""
