"""File layouts of the four known sources: table files, columns, and their canonical names.

Everything in ``LAYOUTS`` is a fixed value of the file formats.
"""

from __future__ import annotations

from dataclasses import dataclass

ITEMS, OCCASIONS, VENUES, TOURS, PLAYS, TRANSITIONS = (
    "items", "occasions", "venues", "tours", "plays", "transitions",
)

FILES = {
    ITEMS: "songdata.csv", OCCASIONS: "showdata.csv", VENUES: "venuedata.csv", TOURS: "tourdata.csv",
    PLAYS: "setlistdata.csv", TRANSITIONS: "transitiondata.csv",
}


@dataclass(frozen=True)
class Layout:
    """Schemas as read, and renames to canonical columns."""

    schemas: dict[str, str]
    renames: dict[str, dict[str, str]]
    required: tuple[str, ...]
    # column: pattern of dates kept as text in the files
    date_columns: dict[str, dict[str, str]]
    # tables with values that may hold line breaks
    multi_line: tuple[str, ...] = (PLAYS,)


LAYOUTS: dict[str, Layout] = {
    "keyed_with_repeats": Layout(
        schemas={
            ITEMS: "song_id int, song string, is_original int, original_artist string, debut_date string, "
                   "last_played string, times_played int, avg_show_gap double",
            OCCASIONS: "show_number int, show_id int, show_date string, venue_id int, tour_id int, show_order int",
            VENUES: "venue_id int, venuename string, city string, state string, country string, location string",
            TOURS: "tour_id int, tourname string",
            PLAYS: "uniqueid long, show_id int, song_id int, setnumber string, position int, tracktime string, "
                   "transition_id int, isreprise int, isjam int, footnote string, isjamchart int, "
                   "jamchart_notes string, soundcheck string, isverified int, isrecommended int",
            TRANSITIONS: "transition_id int, transition string",
        },
        renames={
            ITEMS: {"song_id": "item_id", "song": "item"},
            OCCASIONS: {"show_number": "occ_seq", "show_id": "occasion_id", "show_date": "occ_date",
                        "show_order": "occ_order"},
            VENUES: {"venuename": "venue"},
            TOURS: {"tourname": "tour_name"},
            PLAYS: {"uniqueid": "play_id", "show_id": "occasion_id", "song_id": "item_id",
                    "setnumber": "set_label", "isreprise": "is_repeat", "isjam": "is_jam",
                    "tracktime": "track_time"},
            TRANSITIONS: {"transition": "mark"},
        },
        required=(ITEMS, OCCASIONS, PLAYS),
        date_columns={OCCASIONS: {"occ_date": "yyyy-MM-dd"},
                      ITEMS: {"debut_date": "yyyy-MM-dd", "last_played": "yyyy-MM-dd"}},
    ),
    "keyed_with_exclusions": Layout(
        schemas={
            ITEMS: "song_id int, song string, original_artist string, debut_date string",
            OCCASIONS: "show_number int, showid int, showdate string, venueid int, tourid string, "
                       "exclude_from_stats int, setlist_notes string",
            VENUES: "venueid string, venue string, city string, state string, country string",
            PLAYS: "showid int, uniqueid long, songid int, set string, position int, transition int, "
                   "isreprise int, isjam int, isjamchart int, jamchart_description string, tracktime string, "
                   "gap int, is_original int, soundcheck string, footnote string, exclude int",
            TRANSITIONS: "transition int, trans_mark string",
        },
        renames={
            ITEMS: {"song_id": "item_id", "song": "item"},
            OCCASIONS: {"show_number": "occ_seq", "showid": "occasion_id", "showdate": "occ_date",
                        "venueid": "venue_id", "tourid": "tour_id", "setlist_notes": "occasion_notes"},
            VENUES: {"venueid": "venue_id"},
            PLAYS: {"uniqueid": "play_id", "showid": "occasion_id", "songid": "item_id", "set": "set_label",
                    "isreprise": "is_repeat", "isjam": "is_jam", "transition": "transition_id",
                    "tracktime": "track_time", "gap": "source_gap"},
            TRANSITIONS: {"transition": "transition_id", "trans_mark": "mark"},
        },
        required=(ITEMS, OCCASIONS, PLAYS),
        date_columns={OCCASIONS: {"occ_date": "yyyy-MM-dd"}},
    ),
    "named_by_date": Layout(
        schemas={
            PLAYS: "`Song Name` string, `Date Played` string, Venue string, `Set` string, `Song Before` string, "
                   "`Song After` string, Footnote string",
        },
        renames={
            PLAYS: {"Song Name": "item_id", "Date Played": "occasion_id", "Venue": "venue", "Set": "set_label",
                    "Song Before": "item_before", "Song After": "item_after", "Footnote": "footnote"},
        },
        required=(PLAYS,),
        date_columns={},
    ),
    "named_by_link": Layout(
        schemas={
            ITEMS: "song string, code string, ftp string, ltp string, times_played int, aka string",
            OCCASIONS: "date string, year string, month string, day string, weekday string, date_ec string, "
                       "venue string, city string, state string, show_index_overall int, "
                       "show_index_withinyear int, run_index int, venue_full string, link string",
            PLAYS: "song_name string, `set` string, song_index_set int, song_index_show int, into int, "
                   "link string, song_note_detail string",
        },
        renames={
            ITEMS: {"song": "item", "ftp": "debut_date", "ltp": "last_played"},
            OCCASIONS: {"date": "occ_date", "show_index_overall": "occ_seq", "show_index_withinyear": "seq_in_year",
                        "link": "occasion_id", "date_ec": "day_label"},
            PLAYS: {"song_name": "item_id", "set": "set_label", "song_index_set": "position_in_set",
                    "song_index_show": "position", "link": "occasion_id", "song_note_detail": "footnote"},
        },
        required=(OCCASIONS, PLAYS),
        date_columns={OCCASIONS: {"occ_date": "MM/dd/yy"},
                      ITEMS: {"debut_date": "MM/dd/yy", "last_played": "MM/dd/yy"}},
    ),
}
