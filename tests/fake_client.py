def client(options):
    class Client:
        def head(self):
            return int(options.get("head", 25))

        def logs(self, first, last):
            return [{"address": "0xaa", "topics": [], "data": "0x", "blockNumber": hex(b), "logIndex": hex(i), "transactionHash": f"0x{b:x}{i}"} for b in range(first, last + 1) for i in (1, 0)]

    return Client()


def down(options):
    class Client:
        def head(self):
            raise ConnectionError("no answer")

        def logs(self, first, last):
            raise ConnectionError("no answer")

    return Client()


def _down(options, name):
    import os

    return os.path.exists(f"{options['state']}/{name}.down")


def _endpoint(options, name, lacks):
    import json

    class Client:
        def head(self):
            if _down(options, name):
                raise ConnectionError(name)
            with open(f"{options['state']}/head") as f:
                return int(f.read())

        def logs(self, first, last):
            if _down(options, name):
                raise ConnectionError(name)
            with open(f"{options['state']}/asked-{name}", "a") as f:
                f.write(json.dumps([first, last]) + "\n")
            return [{"address": "0xaa", "topics": [], "data": "0x", "blockNumber": hex(b), "logIndex": hex(i), "transactionHash": f"0x{b:x}{i}"} for b in range(last, first - 1, -1) if b not in lacks for i in (0, 1)]

    return Client()


def left(options):
    return _endpoint(options, "left", {5, 6})


def right(options):
    return _endpoint(options, "right", {11})


def listing(options):
    """Rows in a file; a row named in `stamp` is stamped anew once the second page has been read; a key may be refused."""
    import json
    import os

    class Client:
        def page(self, listing, after, size):
            if options.get("key") == "bad":
                raise ConnectionError("refused")
            path = f"{options['state']}/{listing}.json"
            with open(path) as f:
                rows = json.load(f)
            stamp = f"{options['state']}/stamp"
            if after is not None and listing == "open" and os.path.exists(stamp):
                with open(stamp) as f:
                    name, when = json.load(f)
                os.remove(stamp)
                rows = [dict(r, updated_at=when) if r["id"] == name else r for r in rows]
                with open(path, "w") as f:
                    json.dump(rows, f)
            rows.sort(key=lambda r: (r["updated_at"], r["id"]), reverse=True)
            return [r for r in rows if after is None or (r["updated_at"], r["id"]) < tuple(after)][:size]

    return Client()
