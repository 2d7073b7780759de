"""Reports of one analysis: Markdown, HTML and JSON. They hold bounded rows only, so they are made on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

TITLE = "仓库分析报告"
NO_MODEL = "未配置模型，本次仅输出确定性分析结果。"
UNKNOWN, NOTHING, CLEAN = "未识别", "无", "未发现问题"


def escape_html(value: object) -> str:
    text = str(value)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(sign, entity)
    return text


def narration_lines(narration: dict | None) -> list[str]:
    """Says so where there is no model's account."""
    out = ["## 架构解读", ""]
    if not narration:
        return [*out, f"_{NO_MODEL}_", ""]
    out += [narration["summary"], "", "### 分层推断"]
    out += [f"- **{x['layer']}**：{x['role']}" for x in narration["layering"]]
    out += ["", "### 技术债优先级"]
    for risk in narration["risks"]:
        paths = "、".join(risk["relatedPaths"]) or "—"
        out += [f"#### [{risk['severity']}] {risk['title']}", "", f"- 判断依据：{risk['rationale']}", f"- 建议：{risk['suggestion']}", f"- 相关文件：{paths}", ""]
    return out


def markdown(result: dict) -> str:
    stack, metrics = result["stack"], result["metrics"]
    findings = [f"- [{f['severity']}] {f['message']}（{', '.join(f['files'])}）" for f in result["findings"]] or [f"- {CLEAN}"]
    parts = [
        [f"# {TITLE}", "", f"生成时间：{result['generatedAt']}", ""],
        ["## 技术栈", f"- 框架：{stack.get('framework') or UNKNOWN}", f"- 构建工具：{stack.get('buildTool') or UNKNOWN}", f"- 置信度：{stack['confidence']}", f"- 证据：{'；'.join(stack['evidence']) or NOTHING}", ""],
        ["## 指标", f"- 总分：{metrics['score']}", *(f"- {k}: {v}" for k, v in metrics["dimensions"].items()), ""],
        narration_lines(result.get("narration")),
        ["## Findings", *findings, ""],
        ["## Mermaid", "```mermaid", result["mermaid"], "```"],
    ]
    return "\n".join(line for part in parts for line in part)


def markdown_rows(results: DataFrame) -> DataFrame:
    """text, the report of each result (a JSON text). Reports are bounded, so each is made by one call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": [markdown(json.loads(r)) for r in b["result"]]})

    return results.select("result").mapInPandas(run, "text string")


def html(result: dict) -> str:
    e, stack = escape_html, result["stack"]
    findings = "\n".join(f"{e(f['severity'])}: {e(f['message'])} [{e(', '.join(f['files']))}]" for f in result["findings"]) or CLEAN
    told = result.get("narration")
    if told:
        risks = "".join(f"<li><b>[{e(r['severity'])}] {e(r['title'])}</b> — {e(r['suggestion'])}</li>" for r in told["risks"])
        account = f"<p>{e(told['summary'])}</p><ul>{risks}</ul>"
    else:
        account = f"<p><i>{NO_MODEL}</i></p>"
    sections = [
        ("指标", f"<pre>{e(json.dumps(result['metrics'], ensure_ascii=False, indent=2))}</pre>"),
        ("架构解读", account),
        ("Findings", f"<pre>{findings}</pre>"),
        ("Mermaid", f"<pre>{e(result['mermaid'])}</pre>"),
    ]
    body = "\n".join(f"<h2>{name}</h2>\n{text}" for name, text in sections)
    style = "body{font:15px system-ui;max-width:60rem;margin:2.5rem auto}pre{background:#f4f4f5;padding:.75rem;overflow:auto}"
    return f'<!doctype html>\n<meta charset="utf-8">\n<title>{TITLE}</title>\n<style>{style}</style>\n<h1>{TITLE}</h1>\n<p>技术栈：{e(stack.get("framework") or UNKNOWN)} / {e(stack.get("buildTool") or UNKNOWN)}</p>\n{body}'


def write_reports(folder: str, result: dict) -> list[str]:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    made = {"report.md": markdown(result), "report.html": html(result), "report.json": json.dumps(result, ensure_ascii=False, indent=2)}
    for name, text in made.items():
        (out / name).write_text(text, encoding="utf-8")
    return [str(out / name) for name in made]
