"""The command line: `python -m parchlake COMMAND ...` works on single files; page specs are strict (none is an error)."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from . import api
from .kernel import edit
from .kernel.document import Document

USAGE = """usage: python -m parchlake COMMAND ARGUMENTS ([x]: may be left out)
  inspect FILE [PASSWORD]            rewrite FILE OUT [PASSWORD]        roundtrip FILE [PASSWORD]
  text FILE [PAGE] [PASSWORD]        split FILE PAGES OUT [PASSWORD]    delete FILE PAGES OUT [PASSWORD]
  reorder FILE PAGES OUT [PASSWORD]  merge OUT FILE FILE...             rotate FILE DEGREES OUT [PASSWORD]
  meta-get FILE [PASSWORD]           meta-set FILE JSON OUT [PASSWORD]  export FILE [json|ndjson] [PASSWORD]
  encrypt FILE USER OWNER OUT        decrypt FILE PASSWORD OUT"""


def _changed(change, file: str, spec: str, out: str, password: str = "") -> str:  # noqa: ANN001
    doc = Document.load(Path(file).read_bytes(), password)
    return _wrote(out, change(doc, edit.ranges(spec, doc.page_count(), blank_is_all=False)).to_bytes())


def _wrote(out: str, data: bytes) -> str:
    Path(out).write_bytes(data)
    return f"wrote {out}"


def _merge(out: str, *files: str) -> str:
    if len(files) < 2:
        raise TypeError
    merged = api.merge([Path(x).read_bytes() for x in files])
    return f"{_wrote(out, merged)} ({api.page_count(merged)} pages)"


def _text(file: str, page: str = "", password: str = "") -> str:
    data = Path(file).read_bytes()
    if page.isdigit() and int(page) >= 1:
        return api.extract_text(data, int(page), password)
    n = api.page_count(data, password)
    return "\n".join(f"--- page {k} ---\n{api.extract_text(data, k, password)}" for k in range(1, n + 1))


COMMANDS = {
    "inspect": lambda file, password="": json.dumps(api.inspect(Path(file).read_bytes(), password), indent=2),
    "rewrite": lambda file, out, password="": _wrote(out, api.rewrite(Path(file).read_bytes(), password)),
    "roundtrip": lambda file, password="": "ok: {} objects, {} pages".format(*api.roundtrip(Path(file).read_bytes(), password)),
    "text": _text,
    "split": lambda *a: _changed(edit.extract, *a),
    "delete": lambda *a: _changed(edit.delete, *a),
    "reorder": lambda *a: _changed(edit.reorder, *a),
    "merge": _merge,
    "rotate": lambda file, degrees, out, password="": _wrote(out, api.rotate_pages(Path(file).read_bytes(), "", int(degrees), password)),
    "meta-get": lambda file, password="": json.dumps(api.get_metadata(Path(file).read_bytes(), password), indent=2, ensure_ascii=False),
    "meta-set": lambda file, update, out, password="": _wrote(out, api.set_metadata(Path(file).read_bytes(), update, password)),
    "export": lambda file, kind="json", password="": api.export(Path(file).read_bytes(), lines=kind == "ndjson", password=password),
    "encrypt": lambda file, user, owner, out: _wrote(out, api.encrypt(Path(file).read_bytes(), user, owner)),
    "decrypt": lambda file, password, out: _wrote(out, api.decrypt(Path(file).read_bytes(), password)),
}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print(USAGE, file=sys.stderr)
        return 2
    try:
        print(COMMANDS[args[0]](*args[1:]))
    except (api.PdfError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except TypeError:  # too few arguments, or too many
        print(USAGE, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
