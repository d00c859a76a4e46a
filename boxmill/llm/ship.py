"""Functions for tasks travel by value, so executors need not have the package.

What is broadcast is pickled plainly, by reference to its class: broadcast only arrays, numbers and plain containers.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship() -> None:
    for name, module in list(sys.modules.items()):
        if (name.startswith("boxmill.llm.") or name == "boxmill.filesystem") and module is not None:
            cloudpickle.register_pickle_by_value(module)
