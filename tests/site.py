"""A website in memory, as a transport. Its state is a JSON file, so that tasks see what the test last set."""

import gzip
import json

from corpusflow.sources.http import Reply

PAGE = """<html><head><title>{title} | Site</title><meta property="og:title" content="{title}"><script src="{bundle}"></script></head><body><nav>menu</nav>
<main><article><nav class="theme-doc-breadcrumbs"><ul><li></li><li>Guides</li></ul></nav><div class="theme-last-updated"><time datetime="{updated}T00:00:00Z">u</time></div>
<div class="theme-doc-markdown"><header><h1>{title}</h1></header><p>{body}</p><h2>More</h2><p>Second paragraph of {title}.</p></div></article></main><footer>f</footer></body></html>"""


def page(title, body="Text.", updated="2026-01-01", bundle="b1.js"):
    return PAGE.format(title=title, body=body, updated=updated, bundle=bundle)


class Site:
    def __init__(self, folder):
        self.file = folder / "site.json"
        self.log = folder / "requests.log"
        self.log.write_text("")
        self.set(pages={"https://s.test/guides/a": page("A"), "https://s.test/guides/b": page("B"), "https://s.test/private/secret": page("S")}, lastmod={}, gone=[], etags=True, broken=[])

    def set(self, **change):
        state = json.loads(self.file.read_text()) if self.file.exists() else {}
        self.file.write_text(json.dumps(state | change))

    @property
    def state(self):
        return json.loads(self.file.read_text())

    def requests(self):
        found = self.log.read_text().split()
        self.log.write_text("")
        return [u for u in found if "sitemap" not in u and "robots" not in u]

    def transport(self):
        return Transport(str(self.file), str(self.log))


class Transport:
    def __init__(self, file, log):
        self.file, self.log = file, log

    def __call__(self, url, headers, timeout):
        with open(self.file) as f:
            s = json.load(f)
        with open(self.log, "a") as f:
            f.write(url + "\n")
        ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
        if url.endswith("/robots.txt"):
            return Reply(200, b"User-agent: *\nDisallow: /private/", {}, url)
        if url.endswith("/sitemap_index.xml"):
            return Reply(200, f"<sitemapindex {ns}><sitemap><loc>https://s.test/sitemap.xml.gz</loc></sitemap></sitemapindex>".encode(), {}, url)
        if url.endswith("/sitemap.xml.gz"):
            urls = "".join(f"<url><loc>{u}</loc><lastmod>{s['lastmod'].get(u, '')}</lastmod></url>" for u in sorted(s["pages"]))
            return Reply(200, gzip.compress(f"<urlset {ns}>{urls}</urlset>".encode()), {}, url)
        if url in s["broken"]:
            raise OSError("connection reset")
        if url in s["gone"] or url not in s["pages"]:
            return Reply(404, b"", {}, url)
        body = s["pages"][url]
        etag = f'"{hash(body) if False else len(body)}-{sum(body.encode())}"'
        if s["etags"] and headers.get("If-None-Match") == etag:
            return Reply(304, b"", {"etag": etag}, url)
        return Reply(200, body.encode(), {"etag": etag} if s["etags"] else {}, url)
