"""A small polyglot source tree, written by the tests themselves."""

from __future__ import annotations

from pathlib import Path

FILES = {
    # Python: relative imports, type checking, star, dynamic, routes, environment, unused names, a cycle
    "pkg/__init__.py": "from .core import run\n__all__ = ['run']\n",
    "pkg/core.py": '"""Core of it.\n\nMore."""\nimport os\nfrom typing import TYPE_CHECKING\nfrom . import util\nfrom .sub import deep\n\nif TYPE_CHECKING:\n    from .models import Model\n\nKEY = os.getenv("API_KEY")\n\n\ndef run(m: "Model") -> int:\n    """Runs."""\n    return util.helper(deep.value)\n\n\ndef never_called():\n    pass\n',
    "pkg/util.py": "import json\nimport requests\n\n\ndef helper(x, *, y=1):\n    return x\n\n\ndef orphan():\n    return 1\n",
    "pkg/models.py": "from .core import run\n\n\nclass Model:\n    name = 'm'\n\n    def go(self):\n        return run(self)\n\n\nclass Unused:\n    pass\n",
    "pkg/sub/__init__.py": "",
    "pkg/sub/deep.py": "from ..util import helper as h\n\nvalue = h(1)\n",
    "pkg/api.py": "import importlib\nfrom fastapi import FastAPI\nfrom pkg import core\n\napp = FastAPI()\n\n\n@app.get('/api/users/{user_id}')\ndef one(user_id):\n    return core.run(user_id)\n\n\n@app.route('/api/items', methods=['GET', 'POST'])\ndef items():\n    return importlib.import_module('pkg.models')\n",
    "pkg/__main__.py": "from pkg.api import app\nfrom pkg.util import *\n\nif __name__ == '__main__':\n    print(app)\n",
    "pkg/lonely.py": "X = 1\n",
    "pkg/broken.py": "import os\ndef f(:\n",
    "tests/test_core.py": "from pkg.core import run\n\n\ndef test_run():\n    assert run(1)\n",
    # web: relative, alias, index, .js that is .ts, re-export, require, dynamic, calls
    "web/tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}},\n}\n',
    "web/src/app.ts": "import { api } from './lib/api';\nimport * as fmt from '@lib/format';\nimport React from 'react';\nimport './lib/side.js';\nexport * from './lib';\nconst later = () => import('./lazy');\n// import x from './commented'\nconst s = \"import y from './string'\";\nfetch(`/api/users/${id}`);\naxios.post('/api/items', {});\nconst k = process.env.API_KEY;\n",
    "web/src/lib/api.ts": "import type { T } from './types';\nexport function api(): T { return fetch('/api/items'); }\nexport const make = (x: number) => x;\nexport default class Api extends Base implements I {}\n",
    "web/src/lib/format.ts": "const api = require('./api');\nexport enum Kind { A }\nexport interface Shape {}\n",
    "web/src/lib/index.ts": "export { api } from './api';\n",
    "web/src/lib/side.ts": "/* all\n   comment */\nlet a = 1; // code\n\n",
    "web/src/lib/types.ts": "export type T = number;\n",
    "web/src/lazy.tsx": "export const Lazy = 1;\n",
    # Java
    "j/src/main/java/com/acme/App.java": "package com.acme;\nimport com.acme.util.Strings;\nimport com.acme.model.*;\nimport static com.acme.util.Strings.join;\nimport java.util.List;\nimport com.acme.gone.Missing;\nimport org.other.Thing;\npublic class App extends Base implements Runnable {\n  private int n;\n  public static void main(String[] args) { run(); }\n  public void run() {}\n}\n",
    "j/src/main/java/com/acme/Base.java": "package com.acme;\npublic abstract class Base {}\n",
    "j/src/main/java/com/acme/util/Strings.java": "package com.acme.util;\npublic final class Strings { public static String join() { return \"import fake.Fake;\"; } }\n",
    "j/src/main/java/com/acme/model/User.java": "package com.acme.model;\npublic record User(String name, int age) {}\n",
    "j/src/main/java/com/acme/model/Role.java": "package com.acme.model;\npublic enum Role { ADMIN, USER }\n",
    # Kotlin
    "k/Main.kt": "package app\nimport app.data.Store\nimport app.data.Store.Companion\nimport app.ui.*\nimport kotlin.math.max\nfun main() { val h = Helper(); Store() }\n",
    "k/Helper.kt": "package app\nclass Helper\nfun assist() = 1\n",
    "k/data/Store.kt": "package app.data\nclass Store : Base()\nopen class Base\n",
    "k/ui/View.kt": "package app.ui\ninterface View\n",
    # Go
    "g/go.mod": "module example.com/g\n\ngo 1.22\n",
    "g/main.go": 'package main\n\nimport (\n\t"fmt"\n\tu "example.com/g/util"\n\t"github.com/x/y"\n)\n\nfunc main() { fmt.Println(u.Up()) }\n',
    "g/util/doc.go": "package util\n",
    "g/util/up.go": 'package util\n\nimport "example.com/g/util/inner/none"\n\nfunc Up() string { return "" }\n\ntype T struct{}\n',
    # Rust
    "r/src/main.rs": "mod net;\nmod util;\nuse crate::net::client::Client;\nuse crate::util::*;\nuse std::fmt;\nfn main() {}\n",
    "r/src/net/mod.rs": "pub mod client;\npub trait Send: Sync {}\n",
    "r/src/net/client.rs": "use super::Send;\nuse self::inner::X;\n#[derive(Debug, Clone)]\npub struct Client<'a> { x: &'a str }\nimpl<'a> Send for Client<'a> { fn go(&self) {} }\n",
    "r/src/util.rs": "pub fn id() {}\n",
    # Ruby
    "rb/lib/shop.rb": "require 'json'\nrequire 'shop/cart'\nrequire_relative 'shop/item'\nmodule Shop\n  class Error < StandardError; end\nend\n",
    "rb/lib/shop/cart.rb": "class Cart\n  has_many :items\n  def total\n    Item.price\n  end\nend\n",
    "rb/lib/shop/item.rb": "class Item\n  def self.price\n    ENV['RATE']\n  end\nend\n",
    # clones and configuration
    "dup/a.py": "".join(f"step_{i} = compute(value, {i})\n" for i in range(6)),
    "dup/b.py": "x = 1\n\n" + "".join(f"step_{i} = compute(value, {i})  # note\n" for i in range(6)),
    "Dockerfile": "CMD uvicorn pkg.api:app\nRUN python -m pkg\nRUN gunicorn gone.mod:app\n",
    "pyproject.toml": "[project.scripts]\nstart = \"pkg.core:run\"\n",
    "node_modules/x/index.js": "require('y')\n",
}


def write(root: str | Path) -> str:
    for name, text in FILES.items():
        p = Path(root) / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text(text, encoding="utf-8")
    return str(root)
