"""A cookie jar as a plain object: the rules of ``operators.cookies`` for one profile at a time."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from . import url as urls


@dataclass
class Cookie:
    name: str
    value: str
    domain: str
    path: str
    secure: bool = False
    host_only: bool = True
    http_only: bool = False


def domain_match(host: str, domain: str) -> bool:
    return host == domain or bool(domain) and host.endswith(f".{domain}")


def path_match(path: str, cookie_path: str) -> bool:
    return path == cookie_path or path.startswith(cookie_path) and (cookie_path.endswith("/") or path[len(cookie_path) : len(cookie_path) + 1] == "/")


class Jar:
    """Cookies in the order they were last set."""

    def __init__(self, cookies: list[dict] = ()):
        self.cookies = [Cookie(**c) for c in cookies]

    def dump(self) -> list[dict]:
        return [asdict(c) for c in self.cookies]

    def store(self, at: str, header: str) -> None:
        """A Set-Cookie header from an address; what its host may not set is dropped."""
        try:
            u = urls.parse(at)
        except urls.UrlError:
            return
        first, *parts = header.split(";")
        name, found, value = first.partition("=")
        if not found:
            return
        fallback = u.path.rpartition("/")[0] or "/"
        c = Cookie(name.strip(), value.strip(), u.host, fallback)
        for p in parts:
            key, given, v = p.strip().partition("=")
            key = key.lower()
            if given and key == "domain":
                c.domain, c.host_only = v.strip().lstrip(".").strip().lower(), False
            elif given and key == "path":
                c.path = v.strip() if v.strip().startswith("/") else fallback
            elif not given and key == "secure":
                c.secure = True
            elif not given and key == "httponly":
                c.http_only = True
        if not c.host_only and not (c.domain and domain_match(u.host.lower(), c.domain)):
            return
        same = (c.name, c.domain, c.path)
        self.cookies = [x for x in self.cookies if (x.name, x.domain, x.path) != same] + [c]

    def header(self, at: str, script: bool = False) -> str | None:
        """The Cookie header for an address; with ``script`` what a page's script sees."""
        try:
            u = urls.parse(at)
        except urls.UrlError:
            return None
        fits = [
            c for c in self.cookies
            if not (script and c.http_only) and (u.host == c.domain if c.host_only else domain_match(u.host, c.domain)) and path_match(u.path, c.path) and (u.scheme == "https" or not c.secure)
        ]
        return "; ".join(f"{c.name}={c.value}" for c in fits) or None

    def set_script(self, at: str, text: str) -> None:
        """What a script's assignment to its cookies does; it can't make http-only ones. Without an address nothing."""
        if at and not any(p.strip().lower() == "httponly" for p in text.split(";")[1:]):
            self.store(at, text)
