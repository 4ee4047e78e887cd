"""Plain row-by-row models of the booking procedures (the test oracle)."""


def simulate(events, bookings, roles, commands, new_id):
    """events: {eid: (event_time, capacity)}; bookings: {bid: (eid, cust)};
    commands: dicts sorted by request_id.  Returns {request_id: outcome}."""
    bookings = dict(bookings)
    out = {}
    for c in commands:
        rid, cust = c["request_id"], c["customer_id"]
        if roles.get(cust) != "customer":
            out[rid] = "NOT_ALLOWED"
            continue
        if c["kind"] == "create":
            eid = c["event_id"]
            if eid <= 0:
                out[rid] = "INVALID_EVENT"
            elif eid not in events:
                out[rid] = "MISSING"
            elif not (events[eid][0] > c["requested_at"]):
                out[rid] = "PAST"
            elif any(v == (eid, cust) for v in bookings.values()):
                out[rid] = "DUPLICATE"
            elif sum(1 for v in bookings.values() if v[0] == eid) >= events[eid][1]:
                out[rid] = "FULL"
            else:
                bookings[new_id(rid)] = (eid, cust)
                out[rid] = "BOOKED"
        else:
            bid = c["booking_id"]
            hit = bookings.get(bid)
            if bid is None or bid <= 0 or hit is None or hit[1] != cust or hit[0] not in events:
                out[rid] = "MISSING"
            elif not (events[hit[0]][0] > c["requested_at"]):
                out[rid] = "PAST"
            else:
                del bookings[bid]
                out[rid] = "CANCELLED"
    return out


def simulate_profiles(held, requests):
    """held: {customer: e-mail key}; requests: (request_id, customer, key, fits) in order.

    Returns {request_id: granted}; a request that does not fit its column, or of
    an unknown customer, changes nothing.
    """
    held, out = dict(held), {}
    for rid, cust, key, fits in requests:
        out[rid] = not any(k == key and c != cust for c, k in held.items())
        if out[rid] and fits and cust in held:
            held[cust] = key
    return out
