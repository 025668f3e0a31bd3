"""Every name that a function of the package reads is defined somewhere."""

import builtins
import dis
import importlib
import os
import pkgutil
import types

import tallyglass


def code_objects(code):
    yield code
    for part in code.co_consts:
        if isinstance(part, types.CodeType):
            yield from code_objects(part)


def test_no_undefined_globals():
    lacking = []
    for found in pkgutil.walk_packages(tallyglass.__path__, "tallyglass."):
        module = importlib.import_module(found.name)
        if not module.__file__.endswith("__init__.py"):
            with open(module.__file__, encoding="utf-8") as f:
                whole = compile(f.read(), os.path.basename(module.__file__), "exec")
            lacking += [(found.name, i.argval) for code in code_objects(whole) for i in dis.get_instructions(code)
                        if i.opname in ("LOAD_GLOBAL", "LOAD_NAME") and not hasattr(module, i.argval) and not hasattr(builtins, i.argval) and i.argval not in code.co_names[:0]
                        and not (i.opname == "LOAD_NAME" and code.co_name != "<module>")]
    assert not lacking
