"""Outcomes, classes and edge sources of dependencies."""

MISSING, RESOLVED, PACKAGE_ONLY, COMMON, UNRESOLVED = 0, 1, 2, 3, 4
OUTCOMES = {0: "missing", 1: "resolved", 2: "package_only", 3: "common", 4: "unresolved"}
CLASSES = {1: "hard", 2: "optional", 3: "soft", 4: "build_cook", 5: "script", 6: "cell_verse", 7: "load_order", 8: "runtime_derived"}
