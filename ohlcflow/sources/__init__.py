from .derived import bars_from_lineitem, ticks_from_events, intraday_bars_from_events, table
from .store import (read_bars, load_symbol, save_bars, list_symbols, symbols_present,
                    symbols_missing, head)

__all__ = ["bars_from_lineitem", "ticks_from_events", "intraday_bars_from_events", "table",
           "read_bars", "load_symbol", "save_bars", "list_symbols", "symbols_present",
           "symbols_missing", "head"]
