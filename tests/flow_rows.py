"""Rows of canonical flows for tests."""

from __future__ import annotations

FLOW_DDL = (
    "timestamp string, src_ip string, dst_ip string, port double, protocol string, packet_size double, "
    "connection_duration double, login_attempts double, request_rate double, bytes_transferred double, "
    "status_code double, failed_logins double, total_attempts double, anomaly string"
)


def flow(**given):
    """One canonical flow as a tuple in schema order."""
    base = {
        "timestamp": "2024-01-01T00:00:00Z", "src_ip": "a", "dst_ip": "z", "port": 80.0, "protocol": "TCP",
        "packet_size": 100.0, "connection_duration": 1.0, "login_attempts": 0.0, "request_rate": 10.0,
        "bytes_transferred": 999.0, "status_code": 200.0, "failed_logins": 0.0, "total_attempts": 0.0, "anomaly": None,
    }
    assert not set(given) - set(base)
    return tuple({**base, **given}.values())
