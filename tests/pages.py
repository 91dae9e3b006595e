"""Made-up pages around the published result rows."""

# Names and descriptions of well-known pages.
TITLES = {
    "systemd-socket-proxyd.8": "systemd-socket-proxyd - Bidirectionally proxy local sockets to another socket",
    "socket.7": "socket - Linux socket interface",
    "systemd.socket.5": "systemd.socket - Socket unit configuration",
    "socketcall.2": "socketcall - socket system calls",
    "socket.2": "socket - create an endpoint for communication",
    "socketpair.2": "socketpair - create a pair of connected sockets",
    "tipc-socket.8": "tipc-socket - show TIPC socket (port) information",
    "packet.7": "packet - packet interface on device level",
    "unix.7": "unix - sockets for local interprocess communication",
    "raw.7": "raw - Linux IPv4 raw sockets",
    "connect.2": "connect - initiate a connection on a socket",
    "ss.8": "ss - another utility to investigate sockets",
    "udp.7": "udp - User Datagram Protocol for IPv4",
    "netstat.8": "netstat - Print network connections, routing tables, interface statistics",
    "system_data_types.7": "system_data_types - overview of system data types",
    "FILE.3": "system_data_types - overview of system data types",
    "time_t.3": "system_data_types - overview of system data types",
    "va_list.3": "system_data_types - overview of system data types",
    "ftm.7": "feature_test_macros - feature test macros",
    "ls.1": "ls - list directory contents",
    "Socket.9": "Socket - capital letters are letters of their own",
}
SOCKETS = {"packet.7", "unix.7", "raw.7", "connect.2", "ss.8", "udp.7", "netstat.8"}
TYPES = {"system_data_types.7", "FILE.3", "time_t.3", "va_list.3", "ftm.7"}


def page(name: str, title: str, body: str) -> tuple[str, str]:
    section = name.rsplit(".", 1)[1]
    raw = f"{name}\n\nNAME\n       {title}\n\nDESCRIPTION\n{body}\n"
    return f"/share/man{section}/{name}.gz", raw


def body(name: str) -> str:
    words = ["This page is made up."]
    if name in SOCKETS or "socket" in name:
        words.append("It opens a socket.")
    if name in TYPES:
        words.append("See system_data_types for more.")
    return "\n".join(words)


GOLDEN_PAGES = [page(name, title, body(name)) for name, title in TITLES.items()]
