"""The whole graph of a namespace as ordered JSON-lines tables, and a page that shows a bounded part of it."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from weftline.operators import graph as G

PAGE_NODES = 2000


def export(nodes: DataFrame, edges: DataFrame, path: str, compression: str = "gzip") -> None:
    """Nodes by (label, id) and edges by (type, src, dst), sorted across part files; nothing passes the driver. Files are
    compressed, as sorted lines repeat most of the line before; ``none`` leaves them plain."""
    nodes.orderBy("label", "id").write.mode("overwrite").json(f"{path}/nodes", compression=compression)
    edges.orderBy("type", "src", "dst").write.mode("overwrite").json(f"{path}/edges", compression=compression)
    G.type_counts(nodes, edges).coalesce(1).write.mode("overwrite").json(f"{path}/counts", compression=compression)


def page(nodes: DataFrame, edges: DataFrame, title: str = "graph", most: int = PAGE_NODES) -> str:
    """An HTML page with counts and the first ``most`` nodes and the edges among them."""
    shown = nodes.orderBy("label", "id").limit(most).persist()
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").limit(4 * most)
    data = {"nodes": [json.loads(x) for x in shown.toJSON().collect()], "edges": [json.loads(x) for x in kept.toJSON().collect()]}
    counts = "".join(f"<tr><td>{html.escape(r['family'])}</td><td>{html.escape(r['name'] or 'Unknown')}</td><td>{r['n']}</td></tr>" for r in G.type_counts(nodes, edges).orderBy("family", "name").collect())
    body = json.dumps(data, default=str).replace("</", "<\\/")
    return f"""<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{counts}</table>
<input id="q" placeholder="filter"><pre id="out"></pre><script>const g={body};const q=document.getElementById('q'),o=document.getElementById('out');
function show(){{const s=q.value.toLowerCase();const n=g.nodes.filter(x=>(x.id+' '+(x.name||'')).toLowerCase().includes(s));const k=new Set(n.map(x=>x.id));
o.textContent=n.map(x=>x.label+'  '+x.id).join('\\n')+'\\n\\n'+g.edges.filter(e=>k.has(e.src)||k.has(e.dst)).map(e=>e.src+' -'+e.type+'-> '+e.dst).join('\\n')}}q.oninput=show;show()</script>"""
