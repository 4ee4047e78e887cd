import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for folder in (HERE, os.path.dirname(HERE)):
    if folder not in sys.path:
        sys.path.insert(0, folder)

from seatplan.session import get_session  # noqa: E402
from support import D, T, make_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, app_name="seatplan-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    """The reference's seed rows with made-up names, phones and e-mails."""
    from decimal import Decimal
    h = "x" * 60
    return make_tables(
        spark,
        customers=[(1, "Rina Organizer", "+8801000000001", "rina.org@example.com", h, "organizer"),
                   (2, "Omar Planner", "+8801000000002", "omar.org@example.com", h, "organizer"),
                   (3, "Lia Guest", "+8801000000003", "lia.guest@example.com", h, "customer"),
                   (4, "Tomas Visitor", "+8801000000004", "tomas.v@example.com", h, "customer")],
        venues=[(1, "Grand Hall", "Block A", 500), (2, "Maker Space Room", "Floor 2", 180),
                (3, "Lawn Stage", "South Field", 900)],
        staff=[(1, "Kai Tech", "Technical Lead", "+8802000000001"),
               (2, "Mei Desk", "Registration", "+8802000000002"),
               (3, "Sam Guard", "Security", "+8802000000003")],
        suppliers=[(1, "Food Co", "+8803000000001", "Catering"),
                   (2, "AV Works", "+8803000000002", "Audio Visual"),
                   (3, "Print Hub", "+8803000000003", "Printing")],
        events=[(1, 1, 1, "Research Fair", T(2026, 5, 10, 10, 0), Decimal("12000.00")),
                (2, 2, 2, "Pitch Day", T(2026, 5, 22, 14, 0), Decimal("8500.00")),
                (3, 1, 3, "Culture Night", T(2026, 6, 5, 18, 30), Decimal("15000.00"))],
        bookings=[(1, D(2026, 4, 10), 1, 3), (2, D(2026, 4, 11), 2, 4), (3, D(2026, 4, 12), 3, 3)],
        audit=[(1, 1, 1, 3, "BOOKED", "n", T(2026, 4, 10, 9, 0)),
               (2, 2, 2, 4, "BOOKED", "n", T(2026, 4, 11, 9, 0)),
               (3, 3, 3, 3, "BOOKED", "n", T(2026, 4, 12, 9, 0))],
        event_staff=[(1, 1), (1, 2), (2, 1), (2, 3), (3, 2), (3, 3)],
        event_suppliers=[(1, 2), (1, 3), (2, 2), (3, 1), (3, 3)],
    )
