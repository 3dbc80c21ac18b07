"""Writers: what takes encoded rows to a system.  Each is given its transport, so it runs without one in tests."""
